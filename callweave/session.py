"""Session settings the operators rely on."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Runtime settings; all of them can be changed on a live session.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits the stream side of a join whose key holds a large part of the rows.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split even when that costs one more exchange: a hot key costs more.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Splits hot owners at the export (rebalance hint).
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows are whole texts: smaller batches keep the Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # The JVM compiles methods up to 8000 bytes only. The rule projection is larger
    # as one generated stage; beyond the limit Spark splits it into small methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply :data:`RECOMMENDED` to a session and return it."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as ``spark.checkpoint.dir`` names it.

    Only a local session, where all tasks run on this machine, may leave that unset:
    one temporary folder then serves the session. On a cluster it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(
            "set spark.checkpoint.dir to a folder that the driver and all executors share"
        )
    if master not in _LOCAL:
        _LOCAL[master] = tempfile.mkdtemp(prefix="callweave-")
    return _LOCAL[master]


_LOCAL: dict[str, str] = {}


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, in any file system Spark knows."""
    if "://" not in path and not path.startswith("file:"):
        shutil.rmtree(path, ignore_errors=True)
        return
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder below the shared one that is gone after the block.

    For tables that nothing reads once the block has ended.
    """
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        drop_folder(spark, path)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A runtime setting that holds inside the block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Tasks per core of a scan whose rows cost far more than their reading.
SCAN_TASKS_PER_CORE = 3


@contextmanager
def finer_scans(spark: SparkSession) -> Iterator[None]:
    """Tables are read by several smaller tasks per core inside the block.

    Spark deals files out by their bytes, about one task per core; one task more than there
    are cores then doubles the time of rows that take long.
    """
    tasks = SCAN_TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    with _setting(spark, "spark.sql.files.minPartitionNum", str(tasks)):
        yield


#: Rows that Spark's parquet reader holds decoded at once.
READ_ROWS = 4096


@contextmanager
def wide_rows(spark: SparkSession, held: int) -> Iterator[None]:
    """Tables whose rows hold ``held`` ordinary ones each are read, and handed to Python, by fewer
    rows at once inside the block.

    Spark's reader decodes a number of rows, whatever their size: rows of some 100 KB would
    take a GB of a task's heap.
    """
    rows, arrow = max(1, READ_ROWS // held), "spark.sql.execution.arrow.maxRecordsPerBatch"
    limit = int(spark.conf.get(arrow))
    with (
        _setting(spark, "spark.sql.parquet.columnarReaderBatchSize", str(rows)),
        _setting(spark, arrow, str(min(rows, limit) if limit > 0 else rows)),
    ):
        yield
