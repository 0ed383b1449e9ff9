"""Derived tables that are rebuilt only for the dates whose input has changed.

A table is a folder of runs and numbered manifests. A manifest lists, for every date, the
fingerprint of its input and the folder that holds its rows. A run builds the changed
dates in one job, each into a new folder, and then writes the next manifest; until that is
complete readers see the last one, so a run that fails leaves the table as it was.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Dates of a table: their list is what the driver holds.
MAX_DATES = 100_000
_MANIFEST = "date string, rows long, print string, folder string"


def fingerprints(source: DataFrame, date: str) -> DataFrame:
    """``date, rows, print``: number and a sum of hashes of each date's rows, in any order.

    Two sums of independent hashes: a change that keeps both is not to be expected.
    """
    columns = [F.col(f"`{c}`") for c in source.columns]
    sums = [
        F.sum(F.xxhash64(F.lit(salt), *columns).cast("decimal(38,0)")).cast("string") for salt in (0, 1)
    ]
    return source.groupBy(F.col(date).cast("string").alias("date")).agg(
        F.count("*").alias("rows"), F.concat_ws("/", *sums).alias("print")
    )


def _found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, in any file system Spark knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [str(f.getPath()) for f in files.globStatus(path) or []]


def _manifests(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the complete manifests, ascending."""
    done = _found(spark, f"{target}/manifest-*/_SUCCESS")
    return sorted(int(f.split("/")[-2].split("-")[1]) for f in done)


def manifest(spark: SparkSession, target: str) -> DataFrame | None:
    """The last complete manifest: ``date, rows, print, folder``; ``None`` before the first run."""
    numbers = _manifests(spark, target)
    if not numbers:
        return None
    return spark.read.schema(_MANIFEST).parquet(f"{target}/manifest-{numbers[-1]:09d}")


def read_dates(spark: SparkSession, target: str, like: DataFrame | None = None) -> DataFrame:
    """The table as the last complete manifest has it.

    A table without any date has the columns of ``like``.
    """
    listed = manifest(spark, target)
    folders = [] if listed is None else [
        r["folder"] for r in listed.select("folder").distinct().collect() if r["folder"]
    ]
    if folders:
        return spark.read.parquet(*[f"{target}/{f}" for f in sorted(folders)])
    if like is None:
        raise ValueError(f"{target} holds no dates")
    return like.limit(0)


def rebuild_dates(
    source: DataFrame, build: Callable[[DataFrame], DataFrame], target: str, date: str
) -> DataFrame:
    """Bring the derived table up to date and return it as read back.

    ``build`` makes the table's rows from rows of ``source``; both have the column ``date``, and
    the rows of a date must depend on that date's rows only. It is given the rows of the
    changed and new dates; dates that are gone leave the table. Rows without a date are
    a date of their own. If nothing has changed, nothing is written.
    """
    spark = source.sparkSession
    now = {r["date"]: r for r in fingerprints(source, date).limit(MAX_DATES + 1).collect()}
    if len(now) > MAX_DATES:
        raise ValueError(f"more than {MAX_DATES} dates")
    last = manifest(spark, target)
    before = {} if last is None else {r["date"]: r for r in last.collect()}
    changed = {d for d, r in now.items() if d not in before or before[d]["print"] != r["print"]}
    empty = build(source.limit(0))
    if last is not None and not changed and not before.keys() - now.keys():
        return read_dates(spark, target, empty)
    entries = [(d, r["rows"], r["print"], r["folder"]) for d, r in before.items() if d in now and d not in changed]
    if changed:
        entries += _built(spark, source, build, target, date, now, changed)
    number = (_manifests(spark, target) or [0])[-1] + 1
    spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.parquet(f"{target}/manifest-{number:09d}")
    return read_dates(spark, target, empty)


def _built(spark, source, build, target, date, now, changed) -> list[tuple]:
    """Write the changed dates; their manifest entries."""
    value = F.col(date).cast("string")
    rows = source
    if len(changed) < len(now):
        rows = source.filter(
            value.isin([d for d in changed if d is not None])
            | (value.isNull() if None in changed else F.lit(False))
        )
    run = f"runs/{uuid.uuid4().hex}"
    # Folders are named by the date's digest, so any date is a valid name.
    part = F.md5(F.coalesce(value, F.lit("no date")).cast("binary"))
    made = build(rows).withColumn("__part", part)
    made.hint("rebalance", "__part").write.partitionBy("__part").parquet(f"{target}/{run}")
    there = {f.split("__part=")[-1] for f in _found(spark, f"{target}/{run}/__part=*")}
    entries = []
    for day in changed:
        name = hashlib.md5((day if day is not None else "no date").encode()).hexdigest()
        folder = f"{run}/__part={name}" if name in there else None
        entries.append((day, now[day]["rows"], now[day]["print"], folder))
    return entries
