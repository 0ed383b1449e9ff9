"""Row selections. All compare raw columns, so parquet filters apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from callweave.functions.columns import NEW_CASE, SELF


def in_month(df: DataFrame, column: str, month: str) -> DataFrame:
    """Rows whose ISO date text starts with ``month`` (``YYYY-MM``)."""
    return df.filter(F.col(column).startswith(month))


def in_window(
    df: DataFrame, column: str, since: str | None = None, before: str | None = None
) -> DataFrame:
    """Rows with ``since <= date(column) < before``; either bound may be open.

    The comparison is written on the raw timestamp: no function hides the
    column from the file filters.
    """
    kind = df.schema[column].dataType.simpleString()
    if since is not None:
        df = df.filter(F.col(column) >= F.lit(since).cast(kind))
    if before is not None:
        df = df.filter(F.col(column) < F.lit(before).cast(kind))
    return df


def number_between(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Rows with ``low <= column <= high``."""
    return df.filter(F.col(column).between(low, high))


def text_contains(df: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose text contains ``part``; NULL never does."""
    return df.filter(F.col(column).contains(part))


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that have a value in every named column."""
    return df.dropna(subset=list(columns))


def split_era(
    df: DataFrame, cutoff: str, column: str = "file_date"
) -> tuple[DataFrame, DataFrame]:
    """Rows up to ``cutoff`` and rows after it, compared as text.

    The cut-off need not be a real date (``2018-06-31`` ends a month of 30
    days), so it is never turned into one.
    """
    return df.filter(F.col(column) <= cutoff), df.filter(F.col(column) > cutoff)


def by_channel(df: DataFrame, channel: str) -> DataFrame:
    """Turns of one speaker."""
    return df.filter(F.col("channel") == channel)


def min_duration(df: DataFrame, seconds: int = 10) -> DataFrame:
    """Calls strictly longer than ``seconds``."""
    return df.filter(F.col("duration") > seconds)


def not_self_min_duration(df: DataFrame, seconds: int = 10) -> DataFrame:
    """Calls to anyone but the debtor of at least ``seconds``.

    A call with unknown relation is kept, unlike under a plain ``!=``.
    """
    return df.filter(
        ~F.col("phone_type").eqNullSafe(F.lit(SELF)) & (F.col("duration") >= seconds)
    )


def first_contact_calls(df: DataFrame, cutoff: str, seconds: int = 10) -> DataFrame:
    """First answered calls of an allocation.

    Up to ``cutoff`` call history is incomplete: the case must be new, the call
    the first one, and made on the day of allocation. Later the first call is
    enough. Shorter calls than ``seconds`` are left out.
    """
    return df.filter(
        (F.col("duration") >= seconds)
        & (F.col("yes_call_num") == 1)
        & (
            (F.col("dt") > cutoff)
            | ((F.col("is_first_yes_call") == NEW_CASE) & (F.col("day_num") == 0))
        )
    )


def first_day_first_call(cutoff: str) -> Column:
    """Condition: a call up to ``cutoff`` that opens its case."""
    return (
        (F.col("dt") <= cutoff) & (F.col("day_num") == 0) & (F.col("yes_call_num") == 1)
    )
