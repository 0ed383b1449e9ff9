"""The call table from both record systems."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from callweave.functions.predicates import in_window, not_null, split_era
from callweave.operators.calls import (
    CALL_COLUMNS, allocations_in, attach_call, latest_per_call, latest_up_to_day, resolve_agent,
)


@dataclass(frozen=True)
class Era:
    """Allocation window of one record system: ``since <= date < before``."""

    since: str
    before: str
    overdue: tuple[int, int] = (31, 60)


def build_calls(
    turns: DataFrame,
    records: DataFrame,
    sip: DataFrame,
    extensions: DataFrame,
    roster: DataFrame,
    allocations: DataFrame,
    cutoff: str,
    early: Era,
    late: Era,
    as_of: str,
    group_like: str,
) -> DataFrame:
    """One row per call and user with agent, case and allocation day.

    Transcripts dated up to ``cutoff`` take user and agent from ``records`` and
    the case from the allocation; later ones take user and case from ``sip`` and
    the agent from the day's roster. ``as_of`` is the day of the run: roster days
    from then on are not read.

    Both eras are matched with their allocations in one go, the era being part of
    the key. The days asked for come straight from the record tables, not from the
    joined calls. An era yields a call and user once and the eras do not overlap, so
    neither the records nor the result need a separate removal of duplicates.
    """
    early_turns, late_turns = split_era(turns, cutoff)
    answered = resolve_agent(
        sip, extensions, roster, late.since, as_of, group_like, distinct=False
    )
    is_early = F.col("era") == "early"
    recorded = (
        attach_call(early_turns, records, distinct=False)
        .withColumn("dun_case_id", F.lit(None).cast("long"))
        .withColumn("era", F.lit("early"))
        .unionByName(
            not_null(attach_call(late_turns, answered, distinct=False), "dun_case_id")
            .withColumn("dun_case_id", F.col("dun_case_id").cast("long"))
            .withColumn("era", F.lit("late"))
        )
    )
    candidates = allocations_in(
        allocations, early.since, early.before, early.overdue
    ).withColumn("era", F.lit("early")).unionByName(
        allocations_in(allocations, late.since, late.before, late.overdue).withColumn(
            "era", F.lit("late")
        )
    )
    asked = records.select("user_id", "ringtime", F.lit("early").alias("era")).unionByName(
        in_window(sip, "createtime", late.since).select(
            F.col("ud_1").try_cast("int").alias("user_id"), "ringtime", F.lit("late").alias("era")
        )
    )
    matched = latest_up_to_day(recorded, candidates, ["era", "user_id"], asked).withColumn(
        "dun_case_id", F.when(is_early, F.col("allocated_case")).otherwise(F.col("dun_case_id"))
    )
    return (
        latest_per_call(matched, ["era", "callid", "user_id"])
        .withColumn("time_mark", F.to_date("time_mark"))
        .select(*CALL_COLUMNS)
    )
