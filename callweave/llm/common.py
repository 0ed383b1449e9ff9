"""What the operators of this subpackage share: tables in the shared folder, word patterns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from callweave.session import shared_dir

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run's tables below the folder all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as a table of the run's folder and return it as read back.

    Cuts the lineage: a lost executor later costs a reread, not a recomputation,
    and every reader sees the same rows.
    """
    path = f"{folder}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession, folder: str, *kept: str) -> None:
    """Delete a run's tables but for those that its result still reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.listStatus(path) if files.exists(path) else []:
        if found.getPath().getName() not in kept:
            files.delete(found.getPath(), True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for NULL."""
    return F.coalesce(
        F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)
    ).cast("long")


def fold(doc_id: Column) -> Column:
    """The document's fold: crc32 of its id as text, modulo 4; NULL ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))
