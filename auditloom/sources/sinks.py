"""Writers: tool dumps, baselines and models, as Parquet for Spark and JSON for other tools."""

from __future__ import annotations

import sys
from pathlib import Path

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators.scoring import LogisticModel
from auditloom.sources import storage
from auditloom.sources.configs import BASELINE_FORMAT, read_baseline

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


def tool_dump(servers: DataFrame, tools: DataFrame) -> DataFrame:
    """(name, server JSON) of each server with its tools in order; servers without tools stay."""
    raw = lambda c: F.coalesce(F.to_json(F.try_parse_json(c)), F.lit("{}"))
    named = F.to_json(F.struct("name", "description"))
    one = tools.select("server", "ord", F.concat(F.regexp_replace(named, r"\}$", ""), F.lit(',"inputSchema":'), raw("input_schema"), F.lit(',"annotations":'), raw("annotations"), F.lit("}")).alias("tool"))
    listed = one.groupBy("server").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "tool"))), lambda t: t["tool"]).alias("tools"))
    joined = servers.join(listed, servers["name"] == listed["server"], "left")
    head = F.to_json(F.struct(servers["name"], "transport", "command", "args", "env", "url"))
    body = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"tools":['), F.array_join(F.coalesce("tools", F.array().cast("array<string>")), ","), F.lit("]}"))
    return joined.select(servers["name"], head.alias("head"), "tools").select("name", body.alias("json"))


def write_tool_dump(servers: DataFrame, tools: DataFrame, path: str) -> None:
    """One JSON file of all servers by name, a line for each tool in order; tools of unknown servers are left out.

    A server stands in as many rows as it has tools, so a server with very many of them is written by many tasks.
    """
    raw = lambda c: F.coalesce(F.to_json(F.try_parse_json(c)), F.lit("{}"))
    servers = storage.stored(servers, "servers")  # of a size that Spark knows: where it is small, tools are not shuffled to find theirs
    known = tools.join(servers.select(F.col("name").alias("server")).distinct(), "server", "left_semi")
    cut = lambda c: F.expr(f"substring({c}, 1, length({c}) - 1)")
    tool = known.withColumn("head", F.to_json(F.struct("name", "description"))).select(
        "server", F.lit(1).alias("step"), "ord", F.concat(cut("head"), F.lit(',"inputSchema":'), raw("input_schema"), F.lit(',"annotations":'), raw("annotations"), F.lit("}")).alias("value")
    )
    head = servers.withColumn("head", F.to_json(F.struct("name", "transport", "command", "args", "env", "url")))
    line = lambda step, value: F.struct(F.lit(step).alias("step"), F.lit(0).cast("long").alias("ord"), value.alias("value"))
    ends = head.select(F.col("name").alias("server"), F.inline(F.array(line(0, F.concat(cut("head"), F.lit(',"tools":['))), line(2, F.lit("]}")))))
    write_listed(ends.unionByName(tool), ["server", "step", "ord", "value"], '{"servers":[', "]}", path)


def write_listed(rows: DataFrame, order: list[str], before: str, after: str, path: str) -> None:
    """One JSON file: ``before``, the lines ``value`` in order, ``after``.

    A line that begins with ``{`` gets a comma before it where the line before it ends with ``}``. Tasks write
    sorted parts to the shared folder; the driver joins them byte by byte, in constant memory.
    """

    def with_commas(batches):
        ended = False
        for batch in batches:
            out = []
            for value in batch.column(0).to_pylist():
                out.append("," + value if ended and value[0] == "{" else value)
                ended = value[-1] == "}"
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})

    spark = rows.sparkSession
    parts = storage.shared_path(spark, "parts")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value").mapInArrow(with_commas, "value string").write.text(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, folder = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(parts)
    source, sink = folder.getFileSystem(conf), target.getFileSystem(conf)
    sink.setWriteChecksum(False)  # the file is for other programs, which do not keep checksums beside it
    out = sink.create(target, True)
    try:
        out.write(bytearray(before.encode()))
        ended = False
        for part in sorted((f for f in source.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen() > 0), key=lambda f: f.getPath().getName()):
            stream = source.open(part.getPath())
            begins = stream.read() == ord("{")
            stream.seek(part.getLen() - 2)
            ends = stream.read() == ord("}")  # each line ends with a line feed
            stream.seek(0)
            if ended and begins:
                out.write(ord(","))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            stream.close()
            source.delete(part.getPath(), False)  # so that parts and file together take the room of one
            ended = ends
        out.write(bytearray(after.encode()))
    finally:
        out.close()
        sink.setWriteChecksum(True)


def write_baseline(baseline: tuple[DataFrame, DataFrame], path: str) -> None:
    """Parquet: ``path/servers`` and ``path/tools``; one JSON file where ``path`` ends so."""
    if path.endswith(".json"):
        Path(path).write_text(baseline_json(baseline).first().value, encoding="utf-8")
        return
    for frame, name in zip(baseline, ("servers", "tools"), strict=True):
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def load_baseline(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """A baseline, as Parquet or (``.json``) in the form for other tools; a missing one is a ValueError."""
    if path.endswith(".json"):
        return read_baseline(spark, path)
    try:
        return spark.read.parquet(f"{path}/servers"), spark.read.parquet(f"{path}/tools")
    except PySparkException as e:
        raise ValueError(f"{path}: no baseline: {str(e).splitlines()[0]}") from e


def baseline_json(baseline: tuple[DataFrame, DataFrame], version: str = "1") -> DataFrame:
    """One row of JSON that ``read_baseline`` reads (for baselines that fit one row)."""
    servers, tools = baseline
    fields = [c for c in tools.columns if c not in ("server", "tool")]
    by_server = tools.groupBy("server").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", F.struct(*fields))))).alias("tools"))
    listed = F.collect_list(F.struct("server", F.coalesce("tools", F.create_map().cast(dict(by_server.dtypes)["tools"]))))
    whole = servers.join(by_server, "server", "left").agg(F.map_from_entries(listed).alias("servers"))
    created = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return whole.select(F.to_json(F.struct(F.lit(BASELINE_FORMAT).alias("format"), created.alias("created_at"), F.lit(version).alias("scanner_version"), "servers")).alias("value"))


def write_model(model: LogisticModel, path: str) -> None:
    Path(path).write_text(model.to_json(), encoding="utf-8")
