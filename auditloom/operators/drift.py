"""Drift of tool definitions against an approved baseline: one full outer join on (server, tool)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.functions.fingerprint import fingerprints
from auditloom.relations import as_findings, finding

NAME = "drift"


def last_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last one (as when a mapping is filled row by row)."""
    return _ranked(rows, keys, F.col(order).desc())


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return _ranked(rows, keys, F.col(order).asc())


def _ranked(rows: DataFrame, keys: list[str], order) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_rank = 1").drop("_rank")


def snapshot(tools: DataFrame, interop: bool = False, servers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(servers, tools) of a baseline. ``servers``: those to approve beside the tools', as some have none."""
    known = tools.select("server")
    known = known if servers is None else known.unionByName(servers.select(F.col("name").alias("server")))
    return known.distinct(), _last_fingerprints(tools, interop)


def _last_fingerprints(tools: DataFrame, interop: bool) -> DataFrame:
    """FINGERPRINTS of the last of each tool; made before rows of a tool meet, so that no whole texts are shuffled and sorted."""
    return last_of_each(fingerprints(tools, interop, ("ord",)), ["server", "tool"], "ord").drop("ord")


def drift(tools: DataFrame, baseline: tuple[DataFrame, DataFrame] | None, interop: bool = False, servers: DataFrame | None = None) -> DataFrame:
    """Findings of every difference. Without a baseline a single row says so.

    ``servers``: current servers beside those of the tools, as some have none. The join's keys are the grouping
    of both sides' duplicates, so Spark shuffles each side once.
    """
    if baseline is None:
        return no_baseline(tools.sparkSession)
    known, approved = baseline
    known = known.select("server").distinct()
    current = _last_fingerprints(tools, interop)
    here = tools.select("server")
    here = (here if servers is None else here.unionByName(servers.select(F.col("name").alias("server")))).distinct()
    states = here.withColumn("here", F.lit(True)).join(known.withColumn("known", F.lit(True)), "server", "full_outer").select("server", F.coalesce("here", F.lit(False)).alias("here"), F.coalesce("known", F.lit(False)).alias("known"))
    fresh = states.where("here and not known")
    listed = current.join(fresh.select("server"), "server", "left_semi").groupBy("server").agg(F.array_sort(F.collect_set("tool")).alias("tools"))
    new = fresh.join(listed, "server", "left")
    by_server = as_findings(
        new.unionByName(states.where("known and not here").withColumn("tools", F.lit(None).cast("array<string>"))),
        F.when(F.col("here"), finding(NAME, "medium", F.concat(F.lit("Server is not in the baseline: "), F.col("server")), F.col("server"), evidence=F.struct("tools"))),
        F.when(~F.col("here"), finding(NAME, "info", F.concat(F.lit("Server of the baseline is gone: "), F.col("server")), F.col("server"))),
    )
    old = approved.select("server", "tool", *(F.col(c).alias(f"old_{c}") for c in approved.columns if c not in ("server", "tool")))
    both = states.where("here and known").select("server")
    pairs = current.join(old, ["server", "tool"], "full_outer").join(both, "server", "left_semi")
    was, now = F.col("old_fingerprint").isNotNull(), F.col("fingerprint").isNotNull()
    differs = lambda c: was & now & (F.col(c) != F.col(f"old_{c}"))
    text, title, tool = differs("description_fingerprint"), lambda t: F.concat(F.lit(f"{t}: "), F.col("tool")), F.col("tool")
    by_tool = as_findings(
        pairs,
        F.when(~was, finding(NAME, "low", title("Tool is new since the baseline"), F.col("server"), tool, F.struct("preview"))),
        F.when(text, finding(NAME, "critical", title("Description changed after approval"), F.col("server"), tool, F.struct(F.col("old_preview").alias("before"), F.col("preview").alias("after")))),
        F.when(~text & differs("fingerprint"), finding(NAME, "medium", title("Definition changed beside the description"), F.col("server"), tool)),
        F.when(differs("schema_fingerprint"), finding(NAME, "high", title("Input schema changed after approval"), F.col("server"), tool)),
        F.when(differs("annotations_fingerprint"), finding(NAME, "medium", title("Annotations changed after approval"), F.col("server"), tool)),
        F.when(~now, finding(NAME, "info", title("Tool of the baseline is gone"), F.col("server"), tool)),
    )
    return by_server.unionByName(by_tool)


def no_baseline(spark: SparkSession) -> DataFrame:
    return as_findings(spark.range(1), finding(NAME, "info", F.lit("No baseline: drift is not checked"), F.lit("*")))
