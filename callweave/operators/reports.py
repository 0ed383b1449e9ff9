"""Stability of call features per agent and month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from callweave.functions.columns import CONTACT_CLASS, DEBTOR_CLASS, flag_number

# The metrics of the reports, in column order.
NUMERIC = (
    "day_num", "duration", "t_interaction", "collector_speed", "receiver_speed",
    "ratio_collector_char", "jingban_mean_sentence_num", "jingban_max_sentence_num",
    "yonghu_mean_sentence_num", "yonghu_max_sentence_num",
)

CONTACT_METRICS = NUMERIC + (
    "mention_repayment_time", "mention_owing_amount", "mention_default_days",
    "persuasion_money_loss", "persuasion_credit_loss", "persuasion_contact",
    "persuasion_law", "persuasion_crime", "check_last_phone", "is_argue",
    "is_debtor_nearby", "is_knowing", "is_askrelation", "reaction_notknowing_anfu",
    "reaction_notknowing_fangqi", "reaction_notknowing_zhiwen",
    "reaction_notknowing_qingqiu", "check_other_call", "mention_address",
    "mention_number", "mention_photo", "is_provpmorigin", "is_askingmethod",
    "is_rejection", "mention_nocall", "is_complaint", "is_notknowing",
    "mention_noconnection", "is_helping", "is_investigation", "is_detail",
)

SELF_METRICS = NUMERIC + (
    "mention_repayment_time", "mention_owing_amount", "mention_default_days",
    "persuasion_money_loss", "persuasion_credit_loss", "persuasion_contact",
    "persuasion_law", "persuasion_crime", "check_last_phone", "is_argue",
    "is_askrelation", "check_other_call", "mention_address", "mention_number",
    "mention_photo", "is_provpmorigin", "is_askingmethod", "is_rejection",
    "mention_nocall", "is_complaint", "is_helping", "is_refusal_time_bargain",
    "time_bargain", "is_askingreduction",
)

ALL_SELF_METRICS = NUMERIC + (
    "mention_repayment_time", "mention_owing_amount", "mention_default_days",
    "persuasion_money_loss", "persuasion_credit_loss", "persuasion_contact",
    "persuasion_law", "persuasion_crime", "check_last_phone",
    "is_refusal_time_bargain", "is_argue", "is_askrelation", "check_other_call",
    "mention_address", "mention_number", "mention_photo", "is_provpmorigin",
    "is_askingmethod", "is_rejection", "mention_nocall", "is_complaint",
    "is_askingreduction", "time_bargain", "is_helping",
)


def _share_deviation(hits: Column, count: Column) -> Column:
    """Sample deviation of 0/1 values from their sum; NULL for a single value."""
    hits = hits.cast("double")  # the square of a large sum is no long
    squares = hits - hits * hits / count
    return F.sqrt(F.try_divide(squares, count - 1))


def stability_report(
    base: DataFrame,
    contact: str,
    metrics: Sequence[str],
    first_only: bool = True,
    deviation: bool = True,
    min_rows: int = 50,
) -> DataFrame:
    """Mean and sample deviation of call features per owner and month.

    ``base`` comes from ``lifecycle_base``. Groups of ``min_rows`` rows or less
    are left out. A 0/1 flag needs only its sum: mean and deviation follow from
    it, which keeps the aggregation buffer small enough for generated code.
    """
    calls = base.filter(F.col("new_contact_type") == contact)
    if first_only:
        calls = calls.filter(F.col("order_num") == 1)
    numbers = [m for m in metrics if m in NUMERIC]
    flags = [m for m in metrics if m not in NUMERIC]
    groups = (
        calls.withColumns({m: flag_number(F.col(m)) for m in flags})
        .groupBy("owner_id", F.month(F.col("dt").try_cast("date")).alias("month"))
        .agg(
            F.count("*").alias("num"),
            *[F.avg(m).alias(f"{m}_mean") for m in numbers],
            *([F.stddev_samp(m).alias(f"{m}_std") for m in numbers] if deviation else []),
            *[F.sum(m).alias(f"__hits_{m}") for m in flags],
        )
        .filter(F.col("num") > min_rows)
    )

    def mean(m: str) -> Column:
        if m in numbers:
            return F.col(f"{m}_mean")
        return (F.col(f"__hits_{m}") / F.col("num")).alias(f"{m}_mean")

    def spread(m: str) -> Column:
        if m in numbers:
            return F.col(f"{m}_std")
        return _share_deviation(F.col(f"__hits_{m}"), F.col("num")).alias(f"{m}_std")

    return groups.select(
        "owner_id", "month", "num",
        *[mean(m) for m in metrics],
        *([spread(m) for m in metrics] if deviation else []),
    )


def first_contact_report(base: DataFrame, min_rows: int = 50) -> DataFrame:
    """First calls to contacts other than the debtor."""
    return stability_report(base, CONTACT_CLASS, CONTACT_METRICS, min_rows=min_rows)


def first_self_report(base: DataFrame, min_rows: int = 50) -> DataFrame:
    """First calls to the debtor."""
    return stability_report(base, DEBTOR_CLASS, SELF_METRICS, min_rows=min_rows)


def all_self_report(base: DataFrame, min_rows: int = 50) -> DataFrame:
    """All calls to the debtor, means only, per owner and month."""
    return stability_report(
        base, DEBTOR_CLASS, ALL_SELF_METRICS,
        first_only=False, deviation=False, min_rows=min_rows,
    )
