"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key divided by its quality weight. Within a source
complete epochs come first; the rest of the source's token budget is filled in the order
of the keys, up to the key at which the prefix sum of sizes reaches the budget.

The prefix sum is taken over slots of the key: sizes are summed per source and slot, and
the slot in which the budget ends is cut into slots again, by the keys found in it, until
few rows are left. Only those are sorted, rows with the same key as one; no source is
ever sorted whole, whatever the quality weights do to the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from callweave.llm.common import run_folder, stored, tidy, word_count
from callweave.operators.windows import spread_row_number

#: Slots of the key into which a source, and then a slot, is cut.
KEY_SLOTS = 1024
#: Rows of a slot that are sorted; a slot of more is cut again.
SORTED_ROWS = 10_000
SEED = 20240229


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0.05 and 1: lower for texts full of symbols and for very short ones."""
    value = F.coalesce(text, F.lit(""))
    symbols = F.size(F.regexp_extract_all(value, F.lit(r"[#*$%&|<>{}]"), F.lit(0)))
    clean = 1 - 5 * symbols / F.greatest(F.length(value), F.lit(1))
    return F.greatest(clean, F.lit(0.1)) * F.when(size < 50, 0.5).otherwise(1.0)


def with_keys(docs: DataFrame, text: str = "text", seed: int = SEED) -> DataFrame:
    """Add __size, __key and __tie. The key depends on id and text alone."""
    unit = F.shiftrightunsigned(
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col(text)), 11
    ).cast("double") + 0.5
    return (
        docs.withColumn("__size", word_count(F.col(text)))
        .withColumn("__key", -F.log(unit / F.lit(float(2**53)))
                    / quality_weight(F.col(text), F.col("__size")))
        .withColumn("__tie", F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col(text)))
    )


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Columns source, source_size, target from a stored table source, source_size.

    Sources in code-point order, NULL last, weigh ``weights`` in turn. The targets add
    up to ``share`` of all sizes; none is above ``most`` times its source: what exceeds
    that is shared again among the others by weight. Only sums come to the driver.
    """
    numbered = spread_row_number(
        sizes, [], [F.col("source").isNull(), F.col("source")],
        F.struct(F.col("source").isNull(), F.substring("source", 1, 2)), "__rank",
    )
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") - 1) % len(weights))
    weighed = numbered.select(
        "source", "source_size", weight.alias("weight"),
        (most * F.col("source_size")).alias("cap"),
    )
    goal = share * float(sizes.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= level * F.col("weight")
        row = weighed.agg(
            F.sum(F.when(full, F.col("cap"))).alias("caps"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
            F.count_if(full).alias("capped"),
        ).first()
        if row["capped"] == capped or not row["open"]:
            break
        capped = row["capped"]
        level = (goal - float(row["caps"] or 0)) / row["open"]
    return weighed.select(
        "source", "source_size", F.least("cap", level * F.col("weight")).alias("target")
    )


def _within(keyed: DataFrame, limits: DataFrame) -> DataFrame:
    """The rows of ``keyed`` with the limits of their source, inside them."""
    return keyed.join(
        limits.withColumnRenamed("source", "__source"),
        F.col("source").eqNullSafe(F.col("__source")) & F.col("__key").between(F.col("low"), F.col("high")),
    ).drop("__source")


def _cut(slots: DataFrame, limits: DataFrame) -> DataFrame:
    """The slot of each source in which its budget ends: source, rest, low, high, before, rows.

    ``slots`` has per source and slot the sum of sizes, the rows, and the keys found in it;
    ``limits`` where the slots begin (before) and the budget (rest).
    """
    running = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    named = limits.select(F.col("source").alias("__source"), "rest", F.col("before").alias("__begin"))
    return (
        slots.withColumn("__inside", F.coalesce(F.sum("sum").over(running), F.lit(0)))
        .join(named, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("before", F.col("__begin") + F.col("__inside"))
        .filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("sum") >= F.col("rest")))
        .select("source", "rest", "low", "high", "before", "rows")
    )


def _slots(rows: DataFrame, slot: Column) -> DataFrame:
    return rows.groupBy("source", slot.cast("int").alias("slot")).agg(
        F.sum("__size").alias("sum"), F.count("*").alias("rows"),
        F.min("__key").alias("low"), F.max("__key").alias("high"),
    )


def source_plan(keyed: DataFrame, folder: str, **options) -> DataFrame:
    """One row per source: target, epochs, and where the fractional selection ends.

    A source without words is taken once.
    """
    share = F.col("__key") / (F.col("__key") + 1)
    slots = stored(_slots(keyed, F.floor(share * KEY_SLOTS)), folder, "slots")
    sizes = stored(slots.groupBy("source").agg(F.sum("sum").alias("source_size")), folder, "sizes")
    targets = source_targets(sizes, **options)
    epochs = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(1).cast("long")
    plan = stored(
        targets.withColumn("epochs", epochs).withColumn(
            "rest", F.col("target") - F.col("epochs") * F.col("source_size")
        ),
        folder, "targets",
    )
    limits = stored(_cut(slots, plan.withColumn("before", F.lit(0).cast("long"))), folder, "cut-0")
    step = 0
    while not limits.filter((F.col("rows") > SORTED_ROWS) & (F.col("low") < F.col("high"))).isEmpty():
        step += 1
        # Linear between the keys found; the highest key closes the last slot.
        at = F.try_divide(F.col("__key") - F.col("low"), F.col("high") - F.col("low")) * KEY_SLOTS
        inner = F.when(F.col("low") < F.col("high"), F.least(F.floor(at), F.lit(KEY_SLOTS - 1))).otherwise(0)
        inside = _within(keyed.select("source", "__key", "__size"), limits.select("source", "low", "high"))
        finer = _slots(inside.withColumn("__slot", inner).drop("low", "high"), F.col("__slot"))
        limits = stored(_cut(stored(finer, folder, f"slots-{step}"), limits), folder, f"cut-{step}")
    # Rows of one key are equal in id and text: taken alike, and one row of the sort.
    place = F.struct("__key", "__tie", "doc_id")
    inside = (
        _within(keyed.select("source", "doc_id", "__key", "__tie", "__size"), limits.drop("rows"))
        .groupBy("source", "__key", "__tie", "doc_id")
        .agg(F.sum("__size").alias("__size"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    )
    earlier = Window.partitionBy("source").orderBy("__key", "__tie", "doc_id").rowsBetween(
        Window.unboundedPreceding, -1
    )
    last = (
        inside.withColumn("__before", F.col("before") + F.coalesce(F.sum("__size").over(earlier), F.lit(0)))
        .filter(F.col("__before") + F.col("__size") / 2 <= F.col("rest"))
        .groupBy("source").agg(F.max(place).alias("cut_place")).withColumnRenamed("source", "__last")
    )
    ends = limits.select(F.col("source").alias("__source"), F.col("low").alias("cut_low"))
    return stored(
        plan.join(ends, F.col("source").eqNullSafe(F.col("__source")), "left")
        .join(last, F.col("source").eqNullSafe(F.col("__last")), "left")
        .drop("__source", "__last"),
        folder, "plan",
    )


def with_copies(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target and __copies, how often the mix takes the document."""
    chosen = F.coalesce(F.col("__key") < F.col("cut_low"), F.lit(False)) | F.coalesce(
        F.struct("__key", "__tie", "doc_id") <= F.col("cut_place"), F.lit(False)
    )
    named = plan.select(
        F.col("source").alias("__source"), "source_size", "target", "epochs", "cut_low", "cut_place",
    )
    return (
        keyed.join(named, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("__copies", F.col("epochs") + chosen.cast("long"))
        .drop("__source", "epochs", "cut_low", "cut_place")
    )


def mix_report(docs: DataFrame, text: str = "text", folder: str | None = None, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken, one row per document.

    NULL and empty texts have size 0 and nothing is taken of them. Rows equal in id,
    text and source share their key and are taken alike. A NULL source is a source.
    """
    own = folder or run_folder(docs.sparkSession, "mixing")
    keyed = stored(
        with_keys(docs.select("doc_id", "source", F.col(text).alias("text"))).drop("text"),
        own, "keys",
    )
    plan = source_plan(keyed, own, **options)
    if folder is None:
        tidy(docs.sparkSession, own, "keys", "plan")
    return with_copies(keyed, plan).select(
        "doc_id", F.col("__size").alias("size"), "source_size", "target",
        (F.col("__copies") * F.col("__size")).alias("taken"), "source",
    )


def mix(docs: DataFrame, text: str = "text", folder: str | None = None, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns as they were.

    Sizes and keys are computed once and stored beside the rows; only the plan of a source
    is joined to them. A document without words is taken as often as any other with its key.
    """
    own = folder or run_folder(docs.sparkSession, "mixing")
    packed = docs.select(
        "doc_id", "source", F.col(text).alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__document"),
    )
    keyed = stored(with_keys(packed).drop("text"), own, "keyed")
    plan = source_plan(keyed.drop("__document"), own, **options)
    if folder is None:
        tidy(docs.sparkSession, own, "keyed", "plan")
    taken = with_copies(keyed, plan).filter("__copies > 0")
    return taken.select(
        "__document", F.explode(F.sequence(F.lit(1).cast("long"), "__copies")).alias("__copy")
    ).select("__document.*")
