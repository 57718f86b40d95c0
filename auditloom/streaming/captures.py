"""Drift on a stream of captured tool definitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTURE = "server string, name string, description string, input_schema string, annotations string, captured timestamp"


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines files of captured tools as they arrive."""
    return spark.readStream.schema(CAPTURE).json(path)


def stream_fingerprints(captures: DataFrame, late: str = "1 hour") -> DataFrame:
    """Fingerprints with their time; the same definition captured again within ``late`` comes once."""
    text = F.coalesce("description", F.lit(""))
    rows = captures.withWatermark("captured", late).select("server", F.col("name").alias("tool"), "captured", F.sha2(text, 256).alias("description_fingerprint"))
    return rows.dropDuplicatesWithinWatermark(["server", "tool", "description_fingerprint"])


def changed_since(stream: DataFrame, approved: DataFrame) -> DataFrame:
    """Captures whose description differs from the approved one, or that are not approved: a stream-static join."""
    known = approved.select("server", "tool", F.col("description_fingerprint").alias("approved"))
    joined = stream.join(known, ["server", "tool"], "left")
    state = F.when(F.col("approved").isNull(), "new").when(F.col("approved") != F.col("description_fingerprint"), "changed")
    return joined.withColumn("state", state).where("state is not null").select("server", "tool", "captured", "state")


def change_rate(changes: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Changes for each server and time window."""
    return changes.groupBy(F.window("captured", window), "server").agg(F.count("*").alias("changes"))


def write_findings(changes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    return changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


