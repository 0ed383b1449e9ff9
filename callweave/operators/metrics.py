"""Numeric call metrics and the call feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from callweave.functions.columns import AGENT, USER, sentence_length
from callweave.functions.rules import RuleSet
from callweave.functions.rules_zh import MANDARIN
from callweave.operators.windows import only_unique

TEXT_METRICS = [
    "t_interaction", "collector_speed", "receiver_speed", "ratio_collector_char",
    "jingban_mean_sentence_num", "jingban_max_sentence_num",
    "yonghu_mean_sentence_num", "yonghu_max_sentence_num",
]

CALL_ATTRIBUTES = [
    "user_id", "dun_case_id", "owner_id", "dt", "time_mark", "is_first_yes_call",
    "yes_call_num", "day_num", "contact_type", "ringtime", "duration",
]


def text_metric_columns(length: Column) -> list[Column]:
    """The aggregates of a call over its turns; ``length`` is that of one turn.

    Speaker-wise figures are conditional aggregates of one pass: a call without
    turns of a speaker gets NULL.
    """
    agent, user = F.col("channel") == AGENT, F.col("channel") == USER
    return [
        F.max("seq_id").alias("t_interaction"),
        F.max(F.when(agent, F.col("speed"))).alias("collector_speed"),
        F.max(F.when(user, F.col("speed"))).alias("receiver_speed"),
        F.try_divide(F.sum(F.when(agent, length)), F.sum(length)).alias("ratio_collector_char"),
        F.avg(F.when(agent, length)).alias("jingban_mean_sentence_num"),
        F.max(F.when(agent, length)).alias("jingban_max_sentence_num"),
        F.avg(F.when(user, length)).alias("yonghu_mean_sentence_num"),
        F.max(F.when(user, length)).alias("yonghu_max_sentence_num"),
    ]


def call_attributes(calls_plus: DataFrame) -> DataFrame:
    """The columns of the call table that go into the metrics."""
    return calls_plus.select(
        "callid", "user_id", "dun_case_id", "owner_id", F.col("file_date").alias("dt"),
        "time_mark", "is_first_yes_call", "yes_call_num", "day_num",
        F.col("phone_type").alias("contact_type"), "ringtime", "duration",
    )


def call_metrics(
    turns: DataFrame, calls_plus: DataFrame, bytes_per_char: int | None = 3
) -> DataFrame:
    """One row per transcribed call and call record: attributes and text metrics."""
    length = sentence_length(F.col("content"), bytes_per_char)
    per_call = turns.groupBy("callid").agg(*text_metric_columns(length))
    return per_call.join(call_attributes(calls_plus), "callid", "left").select(
        "callid", *CALL_ATTRIBUTES, *TEXT_METRICS
    )


FEATURE_HEAD = [
    "dt", "owner_id", "user_id", "dun_case_id", "callid", "contact_type", "ringtime",
    "duration", *TEXT_METRICS, "time_mark", "is_first_yes_call", "yes_call_num", "day_num",
]


def drop_ambiguous(metrics: DataFrame, flags: DataFrame) -> DataFrame:
    """Metrics with flags, for calls that occur once on both sides.

    This is the intent of excluding the repeated calls of either side by
    ``NOT IN``: a call without flags compares as unknown there and goes too, so
    the join is an inner one.
    """
    return only_unique(metrics, "callid").join(
        only_unique(flags.drop("owner_id", "dt", "contact_type"), "callid"), "callid"
    )


def call_features(
    metrics: DataFrame, flags: DataFrame, rules: RuleSet = MANDARIN
) -> DataFrame:
    """The call feature table: attributes, metrics and flags of unambiguous calls."""
    return drop_ambiguous(metrics, flags).select(*FEATURE_HEAD, *rules.names)
