"""Plumbing shared by the training-data operators.

Everything here works on Arrow record batches streamed through ``mapInArrow``: a task holds
one slice of texts at a time, so its memory does not depend on the size of its partition.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on (a longer text forms a slice of its own).
SLICE_BYTES = 1 << 20
#: Bytes of one Arrow batch between the JVM and a Python worker, at most.
BATCH_BYTES = 8 << 20

_FALLBACK_DIR = "file:///tmp/checkpoints"
_shipped: set[str] = set()
_scratch: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, because one text may be megabytes long, and ship this package.

    The bound is the only setting of the session that these operators touch; it changes no
    result, a smaller one stays, and rows in a batch are left as the session has them.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context."""
    key = spark.sparkContext.applicationId
    if key in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="auditloom-")) / "auditloom_package.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(key)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    The folder is taken from the session; only where it is unset on one machine (tests) a local
    one is used, on a cluster that is an error. Paths are removed when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    path = f"{(base or _FALLBACK_DIR).rstrip('/')}/auditloom-{label}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_clean)
    _scratch.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _scratch:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001, S112 - the session may be gone already
            continue


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is frequent with more than this share of the rows, so at most so many keys are.
FREQUENT = 256


def join_counted(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, more: list[str], how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` with the columns ``more`` of ``facts``, which has one row for each key.

    ``count`` is the number of rows that have the key. Keys with more than a 256th of the counted
    rows, of which there are at most 256, are broadcast, and rows that hold one are dealt over all
    tasks; the others are joined by a shuffle. Null keys match nothing. ``facts`` should be stored,
    as it is read twice; ``total`` is the sum of its counts where the caller has it.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0 if total is None else total
    least = max(1, total // FREQUENT)
    facts = facts.select(*keys, *more, F.col(count).alias("_count"))
    named = lambda f, mark: f.select(*(F.col(c).alias(f"_{mark}_{c}") for c in (*keys, *more)), F.lit(True).alias(f"_{mark}"))
    same = lambda mark: [F.col(k) == F.col(f"_{mark}_{k}") for k in keys]
    frequent, others = named(facts.where(F.col("_count") > least), "often"), named(facts.where(F.col("_count") <= least), "else")
    rows = rows.withColumn("_number", F.monotonically_increasing_id())
    first = rows.join(F.broadcast(frequent), same("often"), "left")
    first = first.withColumn("_dealt", F.when(F.col("_often"), F.xxhash64("_number")).otherwise(F.lit(0).cast("long")))
    both = first.join(others.withColumn("_none", F.lit(0).cast("long")), [*same("else"), F.col("_dealt") == F.col("_none")], "left")
    if how == "inner":
        both = both.where(F.coalesce("_often", "_else"))
    kept = [c for c in rows.columns if c != "_number"]
    return both.select(*kept, *(F.when(F.col("_often"), F.col(f"_often_{c}")).otherwise(F.col(f"_else_{c}")).alias(c) for c in more))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice have ``limit`` bytes, or are a single text."""
    text = batch.column(batch.schema.get_field_index(column))
    sizes = np.frombuffer(text.buffers()[1], dtype=_offset_type(text), count=text.offset + len(text) + 1)[text.offset :]
    begin = 0
    for end in range(1, len(text) + 1):
        if end == len(text) or sizes[end + 1] - sizes[begin] > limit:
            yield batch.slice(begin, end - begin)
            begin = end


def _offset_type(text: pa.Array):
    return np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32


def utf8(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows in them (null: empty)."""
    if text.null_count:
        text = text.fill_null("")
    offsets = np.frombuffer(text.buffers()[1], dtype=_offset_type(text), count=text.offset + len(text) + 1)[text.offset :].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further ones (whatever their names) cannot clash."""
    kinds = {"doc_id": "bigint", "text": "string", "lang": "string"}
    return docs.select(*(F.col(f"`{n}`").cast(kinds[n]).alias(n) for n in names))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
