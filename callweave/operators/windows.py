"""Window helpers that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from callweave.sources.sinks import materialize


def spread_row_number(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    slot: Column,
    out: str,
    slot_descending: bool = False,
    target: str | None = None,
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without hot tasks.

    ``slot`` cuts each key's rows into consecutive ranges of the order, e.g. the
    hour of the ordering timestamp. Rows are numbered inside ``(keys, slot)``
    and shifted by the number of rows in the earlier slots. Only counts per slot
    ever meet in one task per key; the rows themselves are shuffled once, on
    the finer key, which the numbering and the join share. NULL keys form a
    group of their own, as in a plain window.

    ``slot`` must follow the first ordering expression: ascending (NULL first),
    or descending (NULL last) with ``slot_descending``. It bounds the rows of a task only as
    far as it divides them.

    The rows and the counts both depend on ``df``. With ``target``, a folder or table,
    the rows are written there once and ``df`` is computed once; the counts then read two
    narrow columns back.
    """
    group = "__group"
    piece = F.struct(*[F.col(k) for k in keys], slot.alias("__slot"))
    inside = Window.partitionBy(group).orderBy(*order)
    numbered = df.withColumn(group, piece)
    if target is not None:
        numbered = materialize(numbered.withColumn("__inside", F.row_number().over(inside)), target)
    sizes = numbered.groupBy(group).agg(F.count("*").alias("__rows"))
    slot_order = F.col(f"{group}.__slot")
    before = (
        Window.partitionBy(*[F.col(f"{group}.{k}") for k in keys])
        .orderBy(slot_order.desc() if slot_descending else slot_order.asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        group, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before")
    )
    if target is None:
        numbered = numbered.withColumn("__inside", F.row_number().over(inside))
    return (
        numbered.join(offsets, group)
        .withColumn(out, (F.col("__before") + F.col("__inside")).cast("int"))
        .drop(group, "__inside", "__before")
    )


def balanced_row_number(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str,
    target: str,
    partitions: int | None = None,
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` in tasks of equal numbers of rows.

    The rows are dealt by ranges of keys and order whose limits Spark draws from the data,
    so a task holds about the same number of rows whatever a key holds and however its
    rows cluster; with a unique last ordering column, rows that tie in the others are cut
    apart as well. Rows are numbered where they are sorted, written to ``target`` once,
    and shifted by the key's rows in earlier ranges; only a row per key and range meets
    elsewhere. NULL keys are a group of their own.

    ``df`` is computed twice, for the limits and for the rows: store it first if it is costly.
    """
    by = [F.col(k) for k in keys] + list(order)
    dealt = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    placed = materialize(
        dealt.sortWithinPartitions(*by).withColumn("__place", F.monotonically_increasing_id()), target
    )
    run = F.struct(*[F.col(k) for k in keys], F.shiftright("__place", 33).alias("__range"))
    numbered = placed.withColumn("__run", run)
    runs = numbered.groupBy("__run").agg(
        F.count("*").alias("__rows"), F.min("__place").alias("__first")
    )
    before = (
        Window.partitionBy(*[F.col(f"__run.{k}") for k in keys]).orderBy("__run.__range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = runs.select(
        "__run", (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")).alias("__shift")
    )
    return (
        numbered.join(offsets, "__run")
        .withColumn(out, (F.col("__shift") + F.col("__place") + 1).cast("int"))
        .drop("__run", "__place", "__shift")
    )


def first_of_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every group.

    Catalyst turns the rank filter into a group limit on both sides of the
    exchange, so each task sends one row per key at most.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__rank", F.row_number().over(window))
        .filter(F.col("__rank") == 1)
        .drop("__rank")
    )


def mark_copies(df: DataFrame, key: str, out: str) -> DataFrame:
    """One row per key, with ``out`` = 1 where the key is unique, 2 where it repeats.

    Two rows are enough to show that a key repeats: the rank filter keeps two
    per key and task before the exchange, so a key with very many copies costs
    no more than any other. NULL keys are dropped. Which row of a repeated key
    stays is not fixed.
    """
    window = Window.partitionBy(key)
    return (
        df.filter(F.col(key).isNotNull())
        .withColumn("__rank", F.row_number().over(window.orderBy(F.lit(1))))
        .filter(F.col("__rank") <= 2)
        .withColumn(out, F.count("*").over(window))
        .filter(F.col("__rank") == 1)
        .drop("__rank")
    )


def only_unique(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs exactly once; NULL keys are dropped."""
    return mark_copies(df, key, "__copies").filter(F.col("__copies") == 1).drop("__copies")


def previous_turn(
    turns: DataFrame, marks: dict[str, Column], block: int = 1024
) -> DataFrame:
    """Add, per name in ``marks``, whether the preceding turn met the condition.

    The preceding turn is the one numbered ``seq_id - 1`` in the same call; the
    result is NULL where there is none. Long calls are cut into blocks of
    ``block`` turns and the last turn of a block is also shown to the next one,
    so no task holds more than a block plus one turn of a call.

    ``seq_id`` is unique in a call, as ``build_turns`` makes it.
    """
    own = F.floor(F.col("seq_id") / block)
    places = F.when(
        F.col("seq_id") % block == block - 1,
        F.array(
            F.struct(own.alias("b"), F.lit(False).alias("guest")),
            F.struct((own + 1).alias("b"), F.lit(True).alias("guest")),
        ),
    ).otherwise(F.array(F.struct(own.alias("b"), F.lit(False).alias("guest"))))
    # One key of both: rows already hashed by call are shuffled anew, on the finer key.
    window = Window.partitionBy(F.struct("callid", "__place.b")).orderBy(
        "seq_id", F.col("__place.guest").desc()
    )
    marked = turns.withColumns({f"__now_{n}": c for n, c in marks.items()})
    placed = marked.withColumn("__place", F.explode(places))
    adjacent = F.lag("seq_id").over(window) == F.col("seq_id") - 1
    shifted = placed.withColumns(
        {n: F.when(adjacent, F.lag(f"__now_{n}").over(window)) for n in marks}
    )
    return shifted.filter(~F.col("__place.guest")).drop(
        "__place", *[f"__now_{n}" for n in marks]
    )
