"""Recognised speech segments to numbered conversation turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from callweave.functions.columns import AGENT, SEPARATOR, byte_length, name_part
from callweave.functions.predicates import by_channel, in_month
from callweave.operators.windows import spread_row_number


def _joined_text(text: str, order: str):
    """Aggregate texts in a stated order: without one the result is not fixed."""
    return F.expr(f"listagg(`{text}`, '{SEPARATOR}') WITHIN GROUP (ORDER BY `{order}`)")


def merge_segments(segments: DataFrame, order: str = "seg_no") -> DataFrame:
    """One row per turn: its segments joined in order."""
    return segments.groupBy(
        "new_name",
        F.col("file_name").alias("callid"),
        F.col("rt_role").alias("channel"),
    ).agg(_joined_text("rt_text", order).alias("content"))


def weighted_speed(raw: DataFrame) -> DataFrame:
    """Mean speech speed per call, speaker and date, weighted by text length."""
    weight = byte_length(F.col("rt_text"))
    return raw.groupBy(
        F.col("file_name").alias("callid"), F.col("rt_role").alias("channel"), "file_date"
    ).agg(
        F.try_divide(F.sum(weight * F.col("rt_speed")), F.sum(weight)).alias("speed")
    )


def attach_speed(turns: DataFrame, speed: DataFrame) -> DataFrame:
    """Turns with speed and date of their call and speaker.

    A call recorded under several dates repeats its turns once per date.
    """
    return turns.join(speed, ["callid", "channel"], "left")


def number_turns(
    turns: DataFrame, slot_width: int = 1024, target: str | None = None
) -> DataFrame:
    """Number the turns of a call by the number in their name.

    Slots of ``slot_width`` name numbers keep a very long call distributed. With
    ``target`` the turns are written there once and their texts are made only once.
    """
    number = name_part(F.col("new_name"))
    return spread_row_number(
        turns,
        ["callid"],
        [number, F.col("new_name"), F.col("channel"), F.col("file_date")],
        F.floor(number / slot_width),
        "seq_id",
        target=target,
    )


def build_turns(
    segments: DataFrame, raw: DataFrame, order: str = "seg_no", target: str | None = None
) -> DataFrame:
    """The turn table: ``file_date, callid, channel, content, seq_id, speed``.

    ``target``: see :func:`number_turns`.
    """
    with_speed = attach_speed(merge_segments(segments, order), weighted_speed(raw))
    return number_turns(with_speed, target=target).select(
        "file_date", "callid", "channel", "content", "seq_id", "speed"
    )


def call_text(
    turns: DataFrame, month: str | None = None, channel: str | None = None
) -> DataFrame:
    """One text per date, call and speaker, turns in order.

    Month and channel select before the aggregation, so the text of other
    months or speakers is never shuffled.
    """
    if month is not None:
        turns = in_month(turns, "file_date", month)
    if channel is not None:
        turns = by_channel(turns, channel)
    return turns.groupBy("file_date", "callid", "channel").agg(
        _joined_text("content", "seq_id").alias("content")
    )


def call_text_all(
    turns: DataFrame, calls: DataFrame, month: str | None = None, channel: str = AGENT
) -> DataFrame:
    """One text per owner, date and call of one speaker.

    The text is a function of the call, so it is built per call and the owners
    are attached afterwards: joining first would copy every turn per owner. A
    call with several rows of one owner repeats its text once per row, as
    joining first does.
    """
    if month is not None:
        turns = in_month(turns, "file_date", month)
    turns = by_channel(turns, channel)
    owners = calls.groupBy("callid", "owner_id").agg(F.count("*").alias("__times"))
    texts = turns.groupBy("file_date", "callid", "channel").agg(
        F.expr("array_sort(collect_list(struct(seq_id, content)))").alias("__turns")
    )
    times = F.coalesce(F.col("__times"), F.lit(1)).cast("int")
    parts = F.flatten(
        F.transform(
            F.col("__turns"), lambda turn: F.array_repeat(turn["content"], times)
        )
    )
    return texts.join(owners, "callid", "left").select(
        "owner_id",
        "file_date",
        "callid",
        "channel",
        F.array_join(parts, SEPARATOR).alias("content"),
    )
