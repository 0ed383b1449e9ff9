"""Calls over the life of an allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from callweave.functions.columns import SELF, contact_class
from callweave.functions.predicates import first_day_first_call, in_window, min_duration
from callweave.operators.windows import balanced_row_number, first_of_group, spread_row_number

ORDER_KEYS = ["owner_id", "dun_case_id", "time_mark", "new_contact_type"]


def case_base(features: DataFrame, cutoff: str) -> DataFrame:
    """Per case, the first call up to ``cutoff`` that opens it."""
    return (
        features.filter(first_day_first_call(cutoff))
        .groupBy("dun_case_id")
        .agg(F.min("ringtime").alias("base"))
    )


def from_first_contact(calls: DataFrame, base: DataFrame) -> DataFrame:
    """Calls of the cases in ``base``, from their first call on."""
    return (
        calls.join(base, "dun_case_id")
        .filter(F.col("ringtime") >= F.col("base"))
        .select(*calls.columns)
    )


def complete_calls(
    features: DataFrame,
    cutoff: str,
    early_min_seconds: int | None = 10,
    min_seconds: int = 10,
    distinct: bool = False,
) -> DataFrame:
    """Calls whose case was followed from its start.

    Up to ``cutoff`` only cases opened in that time, from their first call on;
    after it all calls. Only calls strictly longer than the given seconds count
    (``early_min_seconds=None``: any length up to the cut-off). Each branch
    reads its own dates. The branches do not overlap and ``call_features`` has one
    row per call; for input with repeated rows ``distinct`` removes them.
    """
    early = features.filter(F.col("dt") <= cutoff)
    if early_min_seconds is not None:
        early = min_duration(early, early_min_seconds)
    late = min_duration(features.filter(F.col("dt") > cutoff), min_seconds)
    early = from_first_contact(early, case_base(features, cutoff))
    joined = early.unionByName(late)
    return joined.distinct() if distinct else joined


def contact_order(calls: DataFrame, target: str | None = None) -> DataFrame:
    """Number the calls per owner, case, allocation and contact class.

    Hours serve as slots. With ``target`` the calls are written there once, in ranges of
    equal numbers of rows: for groups with very many calls in an hour.
    """
    order = [F.col("ringtime"), F.col("callid")]
    if target is not None:
        return balanced_row_number(calls, ORDER_KEYS, order, "order_num", target)
    return spread_row_number(
        calls, ORDER_KEYS, order, F.date_trunc("hour", "ringtime"), "order_num"
    )


def lifecycle_base(
    features: DataFrame, cutoff: str, distinct: bool = False, first_only: bool = False
) -> DataFrame:
    """Complete calls with contact class and their ordinal within it.

    ``first_only`` keeps the first call of each and needs no full numbering.
    """
    calls = complete_calls(features, cutoff, distinct=distinct).withColumn(
        "new_contact_type", contact_class(F.col("contact_type"))
    )
    if first_only:
        order = [F.col("ringtime"), F.col("callid")]
        return first_of_group(calls, ORDER_KEYS, order).withColumn("order_num", F.lit(1))
    return contact_order(calls)


def lifecycle_histogram(
    features: DataFrame,
    cutoff: str,
    before: str,
    contact: str | None = None,
    early_min_seconds: int | None = 10,
    min_seconds: int = 10,
    distinct: bool = False,
) -> DataFrame:
    """How many allocations were followed for how many days with how many calls.

    Allocations made before ``before``; ``contact`` selects one contact type.
    """
    calls = in_window(
        complete_calls(features, cutoff, early_min_seconds, min_seconds, distinct),
        "time_mark",
        before=before,
    )
    if contact is not None:
        calls = calls.filter(F.col("contact_type") == contact)
    followed = calls.groupBy("owner_id", "dun_case_id", "time_mark").agg(
        F.max("day_num").alias("day_num"), F.count("*").alias("num")
    )
    return followed.groupBy("day_num", "num").agg(F.count("*").alias("num_num"))


def lifecycle_histogram_self(features: DataFrame, cutoff: str, before: str) -> DataFrame:
    """The histogram of calls to the debtor; up to the cut-off calls of any length."""
    return lifecycle_histogram(
        features, cutoff, before, contact=SELF, early_min_seconds=None
    )
