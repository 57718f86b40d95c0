"""Toxic capability flows: a reader on one tool, a way out on another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.lexicon import TAGS, TOXIC_PAIRS, holds, tags_of
from auditloom.relations import as_findings, downgraded, finding, qualified_name
from auditloom.sources.storage import small_batches, stored

NAME = "toxic_flow"


def capability_tags(codes: Column) -> Column:
    """The capabilities that the codes of a tool's name and description show."""
    return F.array_compact(F.array(*(F.when(holds(codes, p), F.lit(tag)) for tag, p in TAGS.items())))


def with_capabilities(tools: DataFrame) -> DataFrame:
    """(server, name, caps) of each tool."""
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")))
    return small_batches(tools).select("server", "name", tags_of(text).alias("caps"))


def tagged(tools: DataFrame) -> DataFrame:
    """(server, tool, cap), one row for each capability of a qualified tool name; stored, as flows look at it from several sides."""
    return stored(with_capabilities(tools).select("server", qualified_name(F.col("server"), F.col("name")).alias("tool"), F.explode("caps").alias("cap")).distinct(), "tags")


def pair_rules(spark: SparkSession) -> DataFrame:
    rows = [(i, s, k, v) for i, (s, k, v) in enumerate(TOXIC_PAIRS)]
    return spark.createDataFrame(rows, "rule int, source string, sink string, severity string")


def flows_by_pairs(tags: DataFrame) -> DataFrame:
    """Every pair of tools, by a self-join: quadratic, for checks on small inputs."""
    rules = F.broadcast(pair_rules(tags.sparkSession))
    source = tags.select(F.col("server").alias("from_server"), F.col("tool").alias("from_tool"), F.col("cap").alias("source"))
    sink = tags.select(F.col("server").alias("to_server"), F.col("tool").alias("to_tool"), F.col("cap").alias("sink"))
    pairs = source.join(rules, "source").join(sink, "sink").where("from_tool <> to_tool")
    return _finished(pairs.groupBy("rule", "source", "sink", "severity", (F.col("from_server") != F.col("to_server")).alias("crosses")).agg(F.count("*").alias("pairs"), F.min(F.struct("from_tool", "to_tool")).alias("example")))


def flows(tags: DataFrame) -> DataFrame:
    """(rule, source, sink, crosses, severity, pairs, from_tool, to_tool) without forming pairs.

    Counts: within servers the sum of |S||K| - |S and K| over servers; across them |S||K| less the
    sum of |S||K|. Examples are the least pairs; across servers the two least sinks of different
    servers, and for them the least sources, suffice. All are group-bys on (rule, server).
    Qualified names are taken to belong to one server each.
    """
    rules = F.broadcast(pair_rules(tags.sparkSession))
    side = lambda role: tags.withColumnRenamed("cap", role).join(rules, role).select("rule", "server", "tool", F.lit(role).alias("role"))
    both = side("source").unionByName(side("sink"))
    per_tool = both.groupBy("rule", "server", "tool").agg(F.max(F.col("role") == "source").alias("is_source"), F.max(F.col("role") == "sink").alias("is_sink"))
    least = lambda flag: F.min(F.when(F.col(flag), F.col("tool")))
    per_server = per_tool.groupBy("rule", "server").agg(
        F.sum(F.col("is_source").cast("long")).alias("s"), F.sum(F.col("is_sink").cast("long")).alias("k"), F.sum((F.col("is_source") & F.col("is_sink")).cast("long")).alias("both"),
        least("is_source").alias("s1"), least("is_sink").alias("k1"),
    )
    seconds = per_tool.join(per_server.select("rule", "server", "s1", "k1"), ["rule", "server"]).groupBy("rule", "server").agg(
        F.min(F.when(F.col("is_source") & (F.col("tool") != F.col("k1")), F.col("tool"))).alias("s_not_k1"),
        F.min(F.when(F.col("is_sink") & (F.col("tool") != F.col("s1")), F.col("tool"))).alias("k_not_s1"),
    )
    rows = per_server.join(seconds, ["rule", "server"])
    pair = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("from_tool"), b.alias("to_tool")))
    first = pair(F.col("s1"), F.when(F.col("k1") != F.col("s1"), F.col("k1")).otherwise(F.col("k_not_s1")))
    other = pair(F.when(F.col("s1") != F.col("k1"), F.col("s1")).otherwise(F.col("s_not_k1")), F.col("k1"))
    rows = rows.withColumn("example", F.when(first.isNull(), other).otherwise(first)).withColumn("within", F.col("s") * F.col("k") - F.col("both"))
    within = rows.where("within > 0").groupBy("rule").agg(F.sum("within").alias("pairs"), F.min("example").alias("example")).withColumn("crosses", F.lit(False))

    total = rows.groupBy("rule").agg(F.sum("s").alias("sources"), F.sum("k").alias("sinks"), F.sum(F.col("s") * F.col("k")).alias("same_server"), F.min_by(F.col("server"), F.col("k1")).alias("k_server"), F.min("k1").alias("k_first"))
    second = rows.join(total.select("rule", "k_server"), "rule").where("server <> k_server").groupBy("rule").agg(F.min("k1").alias("k_second"))
    # the least source that has a sink on another server, then the least such sink
    known = rows.where("s1 is not null").join(total, "rule").join(second, "rule", "left")
    sinks = known.withColumn("to_tool", F.when(F.col("server") != F.col("k_server"), F.col("k_first")).otherwise(F.col("k_second"))).where("to_tool is not null")
    across = sinks.groupBy("rule").agg((F.first("sources") * F.first("sinks") - F.first("same_server")).alias("pairs"), F.min(F.struct(F.col("s1").alias("from_tool"), "to_tool")).alias("example")).withColumn("crosses", F.lit(True))
    return _finished(within.unionByName(across.where("pairs > 0")).join(rules, "rule"))


def members(tags: DataFrame) -> DataFrame:
    """(rule, crosses, role, server, tool): every tool that is source or sink of a pair, without forming pairs.

    Within a server a tool counts if a tool other than itself is on the other side there, across
    servers if another server has one on that side.
    """
    rules = F.broadcast(pair_rules(tags.sparkSession))
    side = lambda role: tags.withColumnRenamed("cap", role).join(rules, role).select("rule", "server", "tool", F.lit(role).alias("role"))
    per_tool = side("source").unionByName(side("sink")).groupBy("rule", "server", "tool").agg(*(F.max((F.col("role") == r).cast("long")).alias(f"is_{r}") for r in ("source", "sink")))
    per_server = per_tool.groupBy("rule", "server").agg(*(F.sum(f"is_{r}").alias(f"{r}s") for r in ("source", "sink")))
    total = per_server.groupBy("rule").agg(*(F.sum(f"{r}s").alias(f"all_{r}s") for r in ("source", "sink")))
    rows = per_tool.join(per_server.join(F.broadcast(total), "rule"), ["rule", "server"])
    part = lambda role, other, crosses: F.when((F.col(f"is_{role}") > 0) & ((F.col(f"all_{other}s") > F.col(f"{other}s")) if crosses else (F.col(f"{other}s") > F.col(f"is_{other}"))), F.struct(F.lit(crosses).alias("crosses"), F.lit(role).alias("role")))
    found = F.array_compact(F.array(*(part(r, o, c) for r, o in (("source", "sink"), ("sink", "source")) for c in (False, True))))
    return rows.select("rule", "server", "tool", F.explode(found).alias("part")).select("rule", "part.crosses", "part.role", "server", "tool")


def servers(found: DataFrame) -> DataFrame:
    """(rule, crosses, servers): the servers of the members of each side of a rule, sorted."""
    return found.groupBy("rule", "crosses").agg(F.array_sort(F.collect_set("server")).alias("servers"))


def _finished(rows: DataFrame) -> DataFrame:
    severity = F.when(F.col("crosses"), F.col("severity")).otherwise(downgraded(F.col("severity")))
    return rows.select("rule", "source", "sink", "crosses", severity.alias("severity"), F.col("pairs").cast("long").alias("pairs"), F.col("example.from_tool").alias("from_tool"), F.col("example.to_tool").alias("to_tool"))


def toxic_flows(tools: DataFrame) -> DataFrame:
    """Findings, one for each rule and side (across servers or within one)."""
    found = flows(tagged(tools))
    title = F.concat(F.col("source"), F.lit(" to "), F.col("sink"), F.when(F.col("crosses"), " across servers").otherwise(" within a server"), F.lit(": "), F.col("from_tool"), F.lit(" and "), F.col("to_tool"))
    return as_findings(found, finding(NAME, F.col("severity"), title, F.when(F.col("crosses"), "*").otherwise(F.regexp_extract("from_tool", r"^(.*)\.[^.]*$", 1)), evidence=F.struct("pairs", "from_tool", "to_tool", "source", "sink")))
