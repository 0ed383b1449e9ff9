"""Exact deduplication in two passes with a Bloom filter between them.

First pass: the hashes alone are counted; those seen twice or more are put in a filter
of bounded size. Second pass: each row tests the filter. A row that the filter excludes
has no equal and passes straight through; only the others are shuffled and compared by
SHA-256. Equal rows are merged before the exchange, so a text that makes up a third of
all rows costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from callweave.llm import bloom
from callweave.llm.common import run_folder, stored

#: Bound of the filter that is broadcast.
MAX_FILTER_BYTES = 64 << 20


def mark_possible_repeats(
    df: DataFrame, key: str, out: str, folder: str, max_filter_bytes: int = MAX_FILTER_BYTES
) -> DataFrame:
    """Add ``out``: whether the 64-bit hash ``key`` may occur in more than one row."""
    repeated = stored(
        df.groupBy(key).agg(F.count("*").alias("__n")).filter("__n > 1").select(key),
        folder, "repeated",
    )
    blocks = bloom.blocks_for(repeated.count(), max_filter_bytes)
    return bloom.probe(df, key, bloom.build(repeated, key, blocks), blocks, out)


def group_report(docs: DataFrame, text: str = "text", folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; NULL counts as empty. The row with the largest
    doc_id stays; NULL ids are smallest. Of rows equal in id and text one stays. An
    empty table gives an empty result; columns other than doc_id and the text are
    not read.
    """
    folder = folder or run_folder(docs.sparkSession, "exact-dedup")
    value = F.coalesce(F.col(text), F.lit(""))
    digests = stored(
        docs.select("doc_id", F.sha2(value, 256).alias("text_sha256"),
                    F.xxhash64(value).alias("__key")),
        folder, "digests",
    )
    marked = mark_possible_repeats(digests, "__key", "__maybe", folder)
    single = marked.filter("not __maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    rows = (
        marked.filter("__maybe").groupBy("text_sha256", "doc_id")
        .agg(F.count("*").alias("__copies"))
    )
    # A table of its own: the join's sides are then both plain exchanges, and Spark can
    # split a group that makes up a large part of the rows.
    groups = stored(
        marked.filter("__maybe").groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")),
        folder, "groups",
    )
    repeated = (
        rows.join(groups, "text_sha256")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies")))
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__copy") == 1)).alias("kept"),
            "text_sha256",
        )
    )
    return single.unionByName(repeated)


def keep_one(
    docs: DataFrame, text: str = "text", folder: str | None = None, largest: bool = True
) -> DataFrame:
    """The documents without their copies, all columns as they were.

    Which row of a group stays: the one with the largest doc_id, then the largest
    values of the other columns that have an order; or the smallest, NULL ids last.
    """
    folder = folder or run_folder(docs.sparkSession, "exact-dedup")
    value = F.coalesce(F.col(text), F.lit(""))
    order = ["doc_id"] + [
        f.name for f in docs.schema.fields
        if f.name not in ("doc_id", text) and isinstance(f.dataType, T.AtomicType)
    ]
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        F.struct(F.col("doc_id").isNotNull() if largest else F.col("doc_id").isNull(),
                 *[F.col(f"`{c}`") for c in order]).alias("__order"),
        F.xxhash64(value).alias("__key"), F.sha2(value, 256).alias("__sha"),
    )
    keys = packed.select("__key")
    repeated = stored(
        keys.groupBy("__key").agg(F.count("*").alias("__n")).filter("__n > 1").select("__key"),
        folder, "repeated",
    )
    blocks = bloom.blocks_for(repeated.count(), MAX_FILTER_BYTES)
    marked = bloom.probe(packed, "__key", bloom.build(repeated, "__key", blocks), blocks, "__maybe")
    best = F.max_by if largest else F.min_by
    kept = marked.filter("__maybe").groupBy("__sha").agg(best("__row", "__order").alias("__row"))
    return marked.filter("not __maybe").select("__row").union(kept.select("__row")).select("__row.*")
