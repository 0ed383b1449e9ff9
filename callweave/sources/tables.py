"""Readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Agents of a table that are listed to choose folders; more are joined.
MAX_LISTED = 10_000

#: Schema of exported agent transcripts.
AGENT_CALLS = T.StructType([
    T.StructField("owner_id", T.LongType()),
    T.StructField("jx_rank", T.IntegerType()),
    T.StructField("file_date", T.StringType()),
    T.StructField("callid", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("duration", T.IntegerType()),
    T.StructField("phone_type", T.StringType()),
    T.StructField("time_mark", T.DateType()),
    T.StructField("group_name", T.StringType()),
    T.StructField("is_first_yes_call", T.StringType()),
    T.StructField("yes_call_num", T.IntegerType()),
    T.StructField("day_num", T.IntegerType()),
])


def read_table(spark: SparkSession, directory: str | None, name: str) -> DataFrame:
    """A parquet table of a folder, or a catalog table where no folder is given."""
    if directory is None:
        return spark.table(name)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def read_agent_calls(
    spark: SparkSession,
    path: str,
    owners: Sequence[int] | DataFrame | None = None,
    schema: T.StructType = AGENT_CALLS,
) -> DataFrame:
    """Transcripts from CSV with header, one folder or file per agent.

    ``owners`` restricts the agents: a list prunes the folders of an export
    partitioned by owner, so that no other is read. Of a DataFrame with ``owner_id`` the
    agents are listed if they are at most :data:`MAX_LISTED`; more are a semi-join.
    """
    calls = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
        .select(*schema.fieldNames())
    )
    if owners is None:
        return calls
    if isinstance(owners, DataFrame):
        listed = few_values(owners, "owner_id", MAX_LISTED)
        if listed is None:
            return calls.join(owners.select("owner_id"), "owner_id", "left_semi").select(
                *schema.fieldNames()
            )
        owners = listed
    return calls.filter(F.col("owner_id").isin(list(owners)))


def few_values(df: DataFrame, column: str, most: int) -> list | None:
    """The distinct values of a column, without NULL, or ``None`` if there are more than ``most``."""
    found = (
        df.select(F.col(column).alias("value")).filter("value is not null").distinct()
        .limit(most + 1).collect()
    )
    return [r["value"] for r in found] if len(found) <= most else None


def only_days(table: DataFrame, column: str, calls: DataFrame, day: Column, most: int = 4000) -> DataFrame:
    """The rows of ``table`` whose day is one of the calls' days.

    On a table partitioned by that day this chooses the folders before the scan. The days
    are listed if they are at most ``most``; else the table stays as it is, for the join to sort out.
    """
    days = few_values(calls.select(day.alias("day")), "day", most)
    if days is None:
        return table
    return table.filter(F.col(column).isin(days) if days else F.lit(False))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A word list, one word per line, trimmed; column ``word``."""
    return spark.read.text(path).select(F.trim("value").alias("word"))


def docs_from_list(spark: SparkSession, texts: Sequence[str]) -> DataFrame:
    """Literal documents, numbered from 1: ``doc_id, text``."""
    rows = [(i, t) for i, t in enumerate(texts, start=1)]
    return spark.createDataFrame(rows, "doc_id long, text string")
