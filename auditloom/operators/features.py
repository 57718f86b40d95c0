"""The 31 features of a tool definition, in contract order, in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import text as T
from auditloom.functions import lexicon as L
from auditloom.sources.storage import small_batches

#: Names and order of the feature vector.
FEATURES = (
    "log_len", "log_words", "entropy", "non_ascii_ratio", "hidden_unicode", "bidi_control", "encoded_blob", "markup_injection", "html_comment",
    "injection_markers", "concealment", "exfiltration", "credentials", "fs_targets", "cross_tool", "urgency", "directive", "imperative_density",
    "hidden_recipient", "hardcoded_recipient", "redaction_language", "schema_defaults", "schema_additional_props", "schema_wide_enum",
    "schema_nested_desc", "schema_marker_in_props", "conceal_x_exfil", "cred_x_exfil", "fs_x_exfil", "cross_x_urgency", "recipient_x_exfil",
)
SCHEMA_FEATURES = FEATURES[21:26]
WIDE_ENUM = 10


#: Features that are counts of a rule of their own name.
RULED = ("cross_tool", "urgency", "directive", "redaction_language", "injection_markers", "concealment", "exfiltration", "hidden_recipient")


def size_features(text: Column) -> dict[str, Column]:
    return {"log_len": F.log1p(F.length(text)), "log_words": F.log1p(F.size(T.words(text))), "non_ascii_ratio": T.non_ascii_ratio(text)}


def unicode_features(text: Column) -> dict[str, Column]:
    return {"hidden_unicode": T.hidden_count(text), "bidi_control": F.regexp_count(text, F.lit(f"[{T.BIDI}]"))}


def lexicon_features(raw: Column, view: Column, codes: Column) -> dict[str, Column]:
    """Counts of marks in the raw text, of names in its plain view and of phrases in its codes."""
    lowered = F.lower(raw)
    found = {"markup_injection": L.counted(lowered, L.MARKUP), "html_comment": L.counted(raw, L.COMMENT), "credentials": L.counted(view, L.CREDENTIALS), "fs_targets": L.counted(view, L.FS_TARGETS)}
    found |= {n: L.counted(codes, L.RULES[n]) for n in RULED}
    found["hardcoded_recipient"] = L.counted(codes, L.RULES["email_target"]) + L.counted(codes, L.RULES["collector_url"])
    found["imperative_density"] = L.counted(codes, L.RULES["imperatives"]) / F.greatest(F.size(T.words(raw)), F.lit(1))
    return found


def _properties(schema: Column) -> Column:
    return F.coalesce(F.map_values(F.try_variant_get(F.try_parse_json(schema), "$.properties", "map<string,variant>")), F.array().cast("array<variant>"))


def property_codes(schema: Column) -> Column:
    """The codes of the descriptions of the top-level properties of a JSON schema."""
    return L.codes_of_each(F.transform(_properties(schema), lambda p: F.coalesce(F.try_variant_get(p, "$.description", "string"), F.lit(""))))


def schema_features(schema: Column, coded: Column | None = None) -> dict[str, Column]:
    """Counts over the top-level properties of a JSON schema (a bad or absent one gives zeros)."""
    parsed, properties = F.try_parse_json(schema), _properties(schema)
    count = lambda test: F.size(F.filter(properties, lambda p: F.coalesce(test(p), F.lit(False))))
    open_ended = lambda p: _truthy(F.try_variant_get(p, "$.additionalProperties", "variant"))
    marker = "|".join(L.RULES[n] for n in ("injection_markers", "concealment", "exfiltration"))
    return {
        "schema_defaults": count(lambda p: F.try_variant_get(p, "$.default", "variant").isNotNull()),
        "schema_additional_props": count(open_ended) + F.coalesce(open_ended(parsed), F.lit(False)).cast("int"),
        "schema_wide_enum": count(lambda p: F.size(F.try_variant_get(p, "$.enum", "array<variant>")) > WIDE_ENUM),
        "schema_nested_desc": count(lambda p: F.length(F.try_variant_get(p, "$.description", "string")) > 0),
        "schema_marker_in_props": F.size(F.filter(property_codes(schema) if coded is None else coded, lambda c: c.rlike(marker))),
    }


def _truthy(value: Column) -> Column:
    """Whether a VARIANT is what a dynamic language takes for true."""
    return F.coalesce(~F.to_json(value).isin("false", "null", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def interactions(c) -> dict[str, Column]:
    """Capped products; ``c`` gives the column of a feature."""
    least = lambda name, top: F.least(c(name), F.lit(top))
    return {
        "conceal_x_exfil": least("concealment", 1) * least("exfiltration", 2),
        "cred_x_exfil": least("credentials", 2) * least("exfiltration", 2),
        "fs_x_exfil": least("fs_targets", 1) * least("exfiltration", 2),
        "cross_x_urgency": least("cross_tool", 2) * least("urgency", 1),
        "recipient_x_exfil": least("hidden_recipient", 2) * F.greatest(c("exfiltration"), (c("hardcoded_recipient") > 0).cast("int")),
    }


def read_texts(tools: DataFrame) -> DataFrame:
    """``tools`` with entropy, plain view and codes of the description (by the only Python step) and the codes of its schema's texts."""
    schema = F.col("input_schema") if "input_schema" in tools.columns else F.lit("")
    rows = tools.withColumn("_profile", T.profile(F.coalesce(F.col("description"), F.lit("")))).withColumn("_props", property_codes(F.coalesce(schema, F.lit(""))))
    # a generated row: the optimizer does not merge projections across it, so no step runs twice
    rows = rows.select(*tools.columns, "_props", F.explode(F.array("_profile")).alias("_profile"))
    return rows.select(*tools.columns, F.col("_profile.entropy").alias("entropy"), F.col("_profile.view").alias("view"), F.col("_profile.codes").alias("codes"), "_props")


def measured(tools: DataFrame) -> DataFrame:
    """``tools`` with ``_m``, what one Python pass counts in the description, and the codes of its schema's texts."""
    schema = F.col("input_schema") if "input_schema" in tools.columns else F.lit("")
    rows = small_batches(tools).withColumn("_m", T.measured(F.coalesce(F.col("description"), F.lit("")))).withColumn("_props", property_codes(F.coalesce(schema, F.lit(""))))
    return rows.select(*tools.columns, "_props", F.explode(F.array("_m")).alias("_m"))


def of_measures(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` of ``measured`` and the 31 features as doubles; ``keep``: those of the measures to stay too.

    Patterns for rare characters run only on texts that may have them.
    """
    columns = [c for c in rows.columns if c not in ("_m", "_props")]
    text, name, m = F.coalesce(F.col("description"), F.lit("")), F.coalesce(F.col("name"), F.lit("")), lambda n: F.col(f"_m.{n}")
    if_any = lambda there, count: F.when(there, count).otherwise(0)
    found = {n: m(n) for n in ("entropy", "credentials", "fs_targets", *RULED)}
    found |= {"log_len": F.log1p(F.length(text)), "log_words": F.log1p(m("words")), "non_ascii_ratio": T.ratio(m("non_ascii"), F.length(text))}
    found |= {n: if_any(m("odd"), c) for n, c in unicode_features(text).items()}
    found["encoded_blob"] = if_any(m("runs") | (F.length(name) >= T.RUN_LENGTH), T.blob_count(F.concat_ws(" ", name, text)))
    found |= {"markup_injection": if_any(m("marks"), L.counted(F.lower(text), L.MARKUP)), "html_comment": if_any(m("marks"), L.counted(text, L.COMMENT))}
    found |= {"hardcoded_recipient": m("email_target") + m("collector_url"), "imperative_density": m("imperatives") / F.greatest(m("words"), F.lit(1))}
    found |= schema_features(F.coalesce(F.col("input_schema"), F.lit("")), F.col("_props"))
    made = F.inline(F.array(F.struct(*(v.cast("double").alias(n) for n, v in found.items()))))
    rows = rows.select(*columns, *(m(n).alias(f"_{n}") for n in keep), made)
    return rows.select("*", *(v.cast("double").alias(n) for n, v in interactions(F.col).items())).select(*columns, *(F.col(f"_{n}").alias(n) for n in keep), *FEATURES)


def with_features(tools: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``tools`` and the 31 features as doubles; ``keep``: of entropy, view and codes those to stay too."""
    rows = tools
    if read := [n for n in keep if n != "entropy"]:
        rows = read_texts(tools).select(*tools.columns, *read)
    return of_measures(measured(rows)).select(*tools.columns, *keep, *(n for n in FEATURES if n not in keep))


def vector() -> Column:
    return F.array(*(F.col(n) for n in FEATURES))


def strongest_features(limit: int = 5) -> Column:
    """The non-zero features of a row by falling value, as (name, value) structs."""
    pairs = F.array(*(F.struct((-F.col(n)).alias("v"), F.lit(n).alias("name")) for n in FEATURES))
    return F.transform(F.slice(F.array_sort(F.filter(pairs, lambda p: p["v"] != 0)), 1, limit), lambda p: F.struct(p["name"].alias("name"), (-p["v"]).alias("value")))
