"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK_DIR = "file:///tmp/checkpoints"
_written: list[tuple[SparkSession, str]] = []


#: Bytes of an Arrow batch at most.
BATCH_BYTES = 8 << 20


def small_batches(rows: DataFrame) -> DataFrame:
    """``rows``, after the session's bound on the bytes of Arrow batches is lowered: ten thousand long texts do not fit a worker. It changes no result, a smaller one stays."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return rows


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Unset, a local one serves on one machine; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (folder or _FALLBACK_DIR).rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/auditloom-{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _written:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001, S112 - the session may be gone already
            continue


def stored(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written to the shared folder and read back: worked out once, whatever executors are lost later."""
    path = shared_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
