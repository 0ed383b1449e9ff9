"""Call table: calls of both record systems with agent, user and case."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from callweave.functions.columns import case_age, relation_class
from callweave.functions.predicates import in_window, not_null, number_between, text_contains
from callweave.sources.tables import only_days
from callweave.operators.windows import balanced_row_number, first_of_group, spread_row_number

CALL_COLUMNS = [
    "callid", "file_date", "phone", "ringtime", "duration", "user_id",
    "owner_id", "owner_name", "group_name", "dun_case_id", "time_mark",
]

#: What decides between rows of one call that are alike in time and user, after the later date.
TIES = ["owner_id", "phone", "duration", "owner_name", "group_name", "dun_case_id"]


def attach_call(turns: DataFrame, records: DataFrame, distinct: bool = True) -> DataFrame:
    """Call records that have a transcript, with its date, one row each.

    Turns are reduced to their distinct (call, date) before the join: the turn
    text takes no part in it. Records without a user are dropped, which makes
    the join an inner one. ``distinct=False`` leaves repeated records in, for a
    later step that takes one row per call and user anyway.
    """
    dates = turns.select("callid", "file_date").distinct()
    known = not_null(records, "user_id").select(
        F.col("calluuid").alias("callid"),
        F.col("dnis").alias("phone"),
        "ringtime",
        F.col("t_durtion").alias("duration"),
        "user_id",
        "owner_id",
        "owner_name",
        "group_name",
        *[c for c in ("dun_case_id",) if c in records.columns],
    )
    attached = dates.join(known, "callid")
    return attached.distinct() if distinct else attached


def resolve_agent(
    sip: DataFrame,
    extensions: DataFrame,
    roster: DataFrame,
    since: str,
    as_of: str,
    group_like: str,
    distinct: bool = True,
    by_day: bool = False,
) -> DataFrame:
    """Telephone-system records with the agent who sat at the extension that day.

    Only calls that lasted, from ``since`` on, and only agents on the roster of
    the day in a group whose name contains ``group_like``. User and case come
    as text and are NULL where they are no numbers. ``by_day``: the roster is
    partitioned by ``dt``; the days of the calls are listed first and only those are read.
    """
    lasting = in_window(sip, "createtime", since).filter(F.col("t_durtion") > 0)
    dialled = lasting.join(
        extensions.select(
            F.col("extensionnumber").alias("dn"), F.col("user_id").alias("owner_id")
        ),
        "dn",
    ).withColumn("dt", F.to_date("createtime"))
    if by_day:
        roster = only_days(roster, "dt", lasting, F.to_date("createtime"))
    agents = (
        text_contains(in_window(roster, "dt", since, as_of), "group_name", group_like)
        .select("owner_id", "owner_name", "group_name", "dt")
        .distinct()
    )
    resolved = dialled.join(agents, ["owner_id", "dt"]).select(
        "calluuid",
        "dt",
        "ringtime",
        "group_name",
        "owner_id",
        "owner_name",
        F.col("ud_1").try_cast("int").alias("user_id"),
        F.col("ud_2").try_cast("int").alias("dun_case_id"),
        "dnis",
        "t_durtion",
    )
    return resolved.distinct() if distinct else resolved


def allocations_in(
    allocations: DataFrame, since: str, before: str, overdue: tuple[int, int] = (31, 60)
) -> DataFrame:
    """Allocations of a time window with overdue days in a closed range."""
    return number_between(
        in_window(allocations, "time_mark", since, before), "overdue_max_days", *overdue
    )


def asof_allocation(
    calls: DataFrame,
    allocations: DataFrame,
    since: str,
    before: str,
    overdue: tuple[int, int] = (31, 60),
) -> DataFrame:
    """Calls with the latest allocation of their user up to the day of the call.

    An allocation of the same day counts even when it is later than the call.
    Calls without one are dropped. Adds ``time_mark`` (timestamp) and
    ``allocated_case``; ties of ``time_mark`` go to the larger case number.
    """
    candidates = allocations_in(allocations, since, before, overdue)
    return latest_up_to_day(calls, candidates, ["user_id"])


def latest_up_to_day(
    calls: DataFrame,
    allocations: DataFrame,
    keys: Sequence[str],
    asked: DataFrame | None = None,
) -> DataFrame:
    """The matching of :func:`asof_allocation` for allocations already selected.

    ``keys`` are columns of both sides, the user of an allocation being named
    ``user_id`` or ``borrow_user_id``. ``asked`` may give the keys and ``ringtime``
    of the calls, or of more calls, where that is cheaper to read than ``calls``.

    Matching is by calendar day, so both sides are first reduced to one row per
    key and day. The running latest allocation is computed on these day rows
    only, at most one per calendar day and side for a user, however many calls
    or allocations a user has. Calls then fetch their day by an equi-join with
    unique right side; pairs of calls and allocations never arise.
    """
    per_day = (
        allocations.withColumnRenamed("borrow_user_id", "user_id")
        .groupBy(*keys, F.to_date("time_mark").alias("__day"))
        .agg(F.max(F.struct("time_mark", "dun_case_id")).alias("mark"))
        .withColumn("asked", F.lit(False))
    )
    call_days = (
        (calls if asked is None else asked)
        .select(*keys, F.to_date("ringtime").alias("__day"))
        .distinct()
        .withColumn("mark", F.lit(None).cast(per_day.schema["mark"].dataType))
        .withColumn("asked", F.lit(True))
    )
    upto_day = (
        Window.partitionBy(*keys)
        .orderBy("__day")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    latest = (
        per_day.unionByName(call_days)
        .withColumn("latest", F.max("mark").over(upto_day))
        .filter(F.col("asked") & F.col("latest").isNotNull())
        .select(
            *keys,
            "__day",
            F.col("latest.time_mark").alias("time_mark"),
            F.col("latest.dun_case_id").alias("allocated_case"),
        )
    )
    return (
        calls.withColumn("__day", F.to_date("ringtime"))
        .join(latest, [*keys, "__day"])
        .drop("__day")
    )


def latest_per_call(
    calls: DataFrame, keys: Sequence[str] = ("callid", "user_id")
) -> DataFrame:
    """One row per call and user: the one with the latest allocation."""
    return first_of_group(
        calls,
        keys,
        [
            F.col("time_mark").desc(),
            F.col("dun_case_id").desc(),
            F.col("ringtime").desc(),
            F.col("file_date").desc(),
            *TIES,
        ],
    )


def union_eras(early: DataFrame, late: DataFrame) -> DataFrame:
    """Calls of both eras, without duplicate rows."""
    return early.unionByName(late).distinct()


def closest_relation(directory: DataFrame) -> DataFrame:
    """One row per user, phone and day: the closest relation listed."""
    return directory.groupBy("user_id", "phone", "dt").agg(
        F.min("order_id").alias("order_id")
    )


def attach_relation(calls: DataFrame, directory: DataFrame, by_day: bool = False) -> DataFrame:
    """Calls with the relation rank of the number called, as of the call's day.

    ``by_day``: the directory is partitioned by ``dt``; the days of the calls are listed
    first and only those are read.
    """
    if by_day:
        directory = only_days(directory, "dt", calls, F.to_date("ringtime"))
    relation = closest_relation(directory).withColumnRenamed("dt", "__day")
    return (
        calls.withColumn("__day", F.to_date("ringtime"))
        .join(relation, ["user_id", "phone", "__day"], "left")
        .drop("__day")
    )


def call_ordinal(
    calls: DataFrame, slot: Column | None = None, target: str | None = None
) -> DataFrame:
    """Number the answered calls of every user and allocation day.

    A call that both record systems list is there twice, with the same time and number; the
    row of the later date comes first, as in :func:`latest_per_call`.

    Hours serve as slots, so that a user with very many calls is numbered by
    many tasks. With ``target`` the calls are written there once, in ranges of equal
    numbers of rows: for users with very many calls in an hour.
    """
    keys = ["user_id", "time_mark"]
    order = [F.col("ringtime"), F.col("callid")]
    if "file_date" in calls.columns:
        order.append(F.col("file_date").desc())
    order += [F.col(name) for name in TIES if name in calls.columns]
    if target is not None:
        return balanced_row_number(calls, keys, order, "yes_call_num", target)
    hour = F.date_trunc("hour", "ringtime") if slot is None else slot
    return spread_row_number(calls, keys, order, hour, "yes_call_num")


def enrich_calls(calls: DataFrame, directory: DataFrame) -> DataFrame:
    """Calls with relation type, case age, ordinal and day of the allocation."""
    related = attach_relation(call_ordinal(calls), directory)
    return related.select(
        *CALL_COLUMNS,
        relation_class(F.col("order_id")).alias("phone_type"),
        case_age(F.col("time_mark"), F.col("ringtime")).alias("is_first_yes_call"),
        "yes_call_num",
        F.date_diff(F.to_date("ringtime"), F.col("time_mark")).alias("day_num"),
    )


def attach_call_attributes(turns: DataFrame, calls_plus: DataFrame) -> DataFrame:
    """Turns with date, owner and contact type of their call.

    A call of two users yields its turns twice.
    """
    attributes = calls_plus.select(
        "callid",
        F.col("file_date").alias("dt"),
        "owner_id",
        F.col("phone_type").alias("contact_type"),
    )
    return turns.join(attributes, "callid", "left")
