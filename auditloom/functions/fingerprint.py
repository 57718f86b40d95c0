"""Canonical JSON and SHA-256 fingerprints of tool definitions."""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The annotation in which captures keep the kind of a tool; fingerprints of annotations leave it out.
KIND_KEY = "auditloom_kind"
PREVIEW = 200

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


def _canonical(value: str | None, without: str | None = None) -> str:
    try:
        parsed = json.loads(value) if value else {}
    except ValueError:
        parsed = value
    if without and isinstance(parsed, dict):
        parsed.pop(without, None)
    return json.dumps(parsed, sort_keys=True, ensure_ascii=False)


@F.pandas_udf(StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """Keys sorted at every level, non-ASCII kept, default separators; bad JSON as a JSON string."""
    return values.map(_canonical)


@F.pandas_udf(StringType())
def canonical_annotations(values: pd.Series) -> pd.Series:
    return values.map(lambda v: _canonical(v, KIND_KEY))


@F.pandas_udf(StringType())
def canonical_tool(name: pd.Series, description: pd.Series, schema: pd.Series, annotations: pd.Series) -> pd.Series:
    def one(n, d, s, a):
        load = lambda x: json.loads(_canonical(x))
        return json.dumps({"name": n, "description": d, "inputSchema": load(s), "annotations": load(a)}, sort_keys=True, ensure_ascii=False)

    return pd.Series([one(*row) for row in zip(name, description, schema, annotations, strict=True)], dtype=object)


def native_json(value: Column) -> Column:
    """Canonical JSON by Spark's VARIANT: sorted keys, compact; bad JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(value)), value, F.lit("{}"))


def fingerprints(tools: DataFrame, interop: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """FINGERPRINTS of each tool, and the columns ``keep``. ``interop`` gives the digests that other tools write (by an Arrow UDF)."""
    name, text, schema, notes = (F.coalesce(F.col(c), F.lit("")) for c in ("name", "description", "input_schema", "annotations"))
    if interop:
        whole, of_schema, of_notes = canonical_tool(name, text, schema, notes), canonical_json(schema), canonical_annotations(notes)
    else:
        of_schema, of_notes = native_json(schema), native_json(notes)
        whole = F.concat(*(F.sha2(c, 256) for c in (name, text, of_schema, of_notes)))
    digest = lambda c: F.sha2(c, 256)
    return tools.select(
        "server", F.col("name").alias("tool"), digest(whole).alias("fingerprint"), digest(text).alias("description_fingerprint"),
        digest(of_schema).alias("schema_fingerprint"), digest(of_notes).alias("annotations_fingerprint"), F.substring(text, 1, PREVIEW).alias("preview"), *keep,
    )
