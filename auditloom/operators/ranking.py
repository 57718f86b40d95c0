"""Order, summary and gate of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.relations import SEVERITIES, qualified_name, severity_of
from auditloom.sources.storage import stored


def ranked(findings: DataFrame) -> DataFrame:
    """Worst first, then detector, location, title and evidence: a total order whatever the partitions."""
    return findings.withColumn("location", qualified_name(F.col("server"), F.col("tool"))).orderBy(F.desc("severity_rank"), "detector", "location", "title", "evidence")


def by_severity(findings: DataFrame) -> DataFrame:
    """(severity, n) of all severities, also those without findings."""
    spark = findings.sparkSession
    levels = spark.createDataFrame([(s, i) for i, s in enumerate(SEVERITIES)], "severity string, rank int")
    return levels.join(findings.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", "rank", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def summary(findings: DataFrame, servers: DataFrame, tools: DataFrame) -> DataFrame:
    """One row: counts and the worst severity (``info`` without findings)."""
    parts = findings.agg(F.count("*").alias("findings"), severity_of(F.coalesce(F.max("severity_rank"), F.lit(0))).alias("worst"))
    return servers.agg(F.count("*").alias("servers")).join(tools.agg(F.count("*").alias("tools")), F.lit(True)).join(parts, F.lit(True))


def at_or_above(findings: DataFrame, severity: str = "high") -> DataFrame:
    return findings.where(F.col("severity_rank") >= SEVERITIES.index(severity))


def gate(findings: DataFrame, severity: str = "high") -> int:
    """Exit code: 1 with a finding at or above ``severity``, else 0. Stops at the first."""
    return 0 if at_or_above(findings, severity).isEmpty() else 1


def numbered_within(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """``rows`` with ``number``, from 0 within each value of ``group`` in the given order.

    By one range sort on group and order, so that no task holds a whole group. What a group has in
    earlier partitions is counted and broadcast: at most a row for each partition, as only
    the first group of a partition goes on from another. The sorted rows are stored, as the counts
    hold for this run's partitions alone.
    """
    keys = [F.col(group), *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(ranged.withColumn("_part", F.shiftrightunsigned("_at", 33)), "numbered")
    sizes = ranged.groupBy(group, "_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), "_first", before.alias("_before"))
    found = ranged.join(begins, ranged[group].eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return found.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).cast("long").alias("number"))


def least_members(rows: DataFrame, group: str, member: str, most: int) -> DataFrame:
    """(group, ``member``s) with the ``most`` least distinct members of each group, sorted; nulls are no members.

    Each task hands on so many rows of a group only, so a list and the work on it are bounded whatever the group.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(member))
    least = rows.where(F.col(member).isNotNull()).select(group, member).distinct().withColumn("_rank", rank).where(F.col("_rank") <= most)
    return least.groupBy(group).agg(F.array_sort(F.collect_list(member)).alias(f"{member}s"))
