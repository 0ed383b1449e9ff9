"""Quality rules: per-document counts and the frequency of lines across a host's documents.

Lines are normalised (lower case, white space collapsed) and hashed with their host;
a line in more than ``max_documents`` distinct documents of a host is boilerplate and
is removed; a document that loses too much is rejected. Copies of one text count as
one document. Everything is column functions; texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from callweave.llm.common import WORD, run_folder, stored

SYMBOL = r"[#*$%&|<>]"


def document_counts(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, the base counts, and the document's hashed lines with their words.

    A NULL text has no words and no lines. NULL hosts are one host of their own.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        "doc_id", F.col(host).alias("__host"), value.alias("__text"),
        F.regexp_extract_all(value, F.lit(WORD), F.lit(0)).alias("__words"),
        F.filter(F.split(value, "\n"), lambda l: l.rlike(WORD)).alias("__lines"),
    )
    grams = F.transform(
        F.arrays_zip(
            F.col("__words").alias("a"),
            F.slice("__words", F.lit(2), F.size("__words")).alias("b"),
            F.slice("__words", F.lit(3), F.size("__words")).alias("c"),
        ),
        lambda z: F.xxhash64(z["a"], z["b"], z["c"]),
    )
    counted = base.select(
        "doc_id",
        F.monotonically_increasing_id().alias("__row"),
        F.xxhash64("__text").alias("__document"),
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.size(F.regexp_extract_all("__text", F.lit(SYMBOL), F.lit(0)))
        .cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines")))
        .cast("long").alias("n_dup_lines"),
        F.when(F.size("__words") >= 3, F.slice(grams, F.lit(1), F.size("__words") - 2))
        .otherwise(F.array().cast("array<bigint>")).alias("__grams"),
        F.transform(
            "__lines",
            lambda l: F.struct(
                F.xxhash64(
                    F.col("__host").isNull(), F.col("__host"),
                    F.trim(F.regexp_replace(F.lower(l), r"[\x20\x09-\x0D]+", " ")),
                ).alias("line"),
                F.size(F.regexp_extract_all(l, F.lit(WORD), F.lit(0))).alias("words"),
            ),
        ).alias("__lines"),
    )
    # Windows are compared only in documents that have any twice.
    placed = counted.withColumn(
        "__placed",
        F.when(
            F.size(F.array_distinct("__grams")) < F.size("__grams"),
            F.sort_array(
                F.transform("__grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))
            ),
        ),
    )
    starts = placed.withColumn(
        "__starts",
        F.sort_array(
            F.transform(
                F.filter(
                    F.transform(
                        "__placed",
                        lambda s, k: F.struct(
                            s["i"].alias("i"),
                            (
                                F.get("__placed", k - 1)["g"].eqNullSafe(s["g"])
                                | F.get("__placed", k + 1)["g"].eqNullSafe(s["g"])
                            ).alias("again"),
                        ),
                    ),
                    lambda s: s["again"],
                ),
                lambda s: s["i"],
            )
        ),
    )
    covered = F.aggregate(
        F.transform(
            "__starts",
            lambda i, k: F.coalesce(F.least(F.get("__starts", k + 1) - i, F.lit(3)), F.lit(3)),
        ),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    return starts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop(
        "__grams", "__placed", "__starts"
    )


def quality_report(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    max_documents: int = 10,
    min_words: int = 50,
    max_removed: float = 0.5,
    folder: str | None = None,
) -> DataFrame:
    """One row per document with the base counts, words_removed and the verdict.

    ``base_failed``: fewer than ``min_words`` words, or more than half of the words in
    repeated windows. ``kept``: not base_failed, at least ``min_words`` words and at
    least a share of 1 - ``max_removed`` of all words outside removed lines.
    """
    folder = folder or run_folder(docs.sparkSession, "line-quality")
    base = stored(document_counts(docs, text, host), folder, "counts")
    lines = base.select("__row", "__document", F.explode("__lines").alias("__l")).select(
        "__row", "__document", F.col("__l.line").alias("__line"), F.col("__l.words").alias("__n")
    )
    frequent = (
        lines.groupBy("__line").agg(F.count_distinct("__document").alias("__documents"))
        .filter(F.col("__documents") > max_documents).select("__line")
    )
    removed = (
        lines.join(stored(frequent, folder, "frequent"), "__line")
        .groupBy("__row").agg(F.sum("__n").alias("words_removed"))
    )
    left = F.col("n_words") - F.col("words_removed")
    return (
        base.drop("__lines", "__document").join(removed, "__row", "left")
        .withColumn("words_removed", F.coalesce("words_removed", F.lit(0).cast("long")))
        .withColumn(
            "base_failed",
            (F.col("n_words") < min_words)
            | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        )
        .withColumn(
            "kept",
            ~F.col("base_failed") & (left >= min_words)
            & (F.col("words_removed") <= max_removed * F.col("n_words")),
        )
        .drop("__row")
    )
