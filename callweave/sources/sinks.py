"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def materialize(
    df: DataFrame, target: str, stats: bool = False, key: str | None = None, buckets: int = 64
) -> DataFrame:
    """Rebuild a derived table and return it as read back.

    A target with ``/`` is a parquet folder, any other a catalog table. With
    ``stats`` the columns of a catalog table are analysed for the optimizer.

    With ``key`` a catalog table is cut into ``buckets`` by the key's hash and sorted in
    them: what joins or groups by the key then needs no exchange. A bucket is read by one task,
    so a table whose largest bucket holds more than :data:`MAX_BUCKET_SHARE` times the
    mean is read as plain files instead, for adaptive execution to split.
    """
    spark = df.sparkSession
    if "/" in target:
        df.write.mode("overwrite").parquet(target)
        return spark.read.parquet(target)
    if key is None:
        df.write.mode("overwrite").saveAsTable(target)
    else:
        # One file a bucket: the rows of a bucket are brought together before they are written.
        dealt = df.repartition(buckets, key)
        dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(target)
    if stats:
        spark.sql(f"ANALYZE TABLE {target} COMPUTE STATISTICS FOR ALL COLUMNS")
    table = spark.table(target)
    if key is not None and _uneven(table, key, buckets):
        return spark.read.parquet(*table.inputFiles())
    return table


#: Times the mean rows of a bucket that the largest may hold.
MAX_BUCKET_SHARE = 4


def _uneven(table: DataFrame, key: str, buckets: int) -> bool:
    sizes = table.groupBy(F.pmod(F.hash(key), F.lit(buckets)).alias("b")).agg(F.count("*").alias("n"))
    most, whole = sizes.agg(F.max("n"), F.sum("n")).first()
    return bool(most) and most > MAX_BUCKET_SHARE * max(whole / buckets, 1000)


def export_by_owner(
    df: DataFrame, path: str, owner: str = "owner_id", rows_per_file: int = 1_000_000
) -> None:
    """Write CSV with header, one folder per agent, in one job.

    Rows are gathered by owner, but adaptive execution splits an owner that is
    too large for a task and joins small ones; ``rows_per_file`` bounds a file.
    """
    (
        df.hint("rebalance", owner)
        .write.mode("overwrite")
        .partitionBy(owner)
        .option("header", True)
        .option("escape", '"')
        .option("maxRecordsPerFile", rows_per_file)
        .csv(path)
    )


def write_report(
    df: DataFrame, path: str, fmt: str = "csv", single_file: bool = False
) -> None:
    """Write a result; ``single_file`` only for results that are small by nature."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)
