"""Toxicity by a factorization machine over hashed terms.

Terms are words and their beginnings, hashed. The ones whose share of toxic documents is
far from the average are chosen on the labelled sample; then, among the documents that
hold a chosen term of toxic documents, the ones whose share is far from the average there: their
partners, which may well be neutral by themselves. The machine gives each a weight and a
vector, so pairs of terms (an insult together with a group) have weights of their own that a
linear score lacks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from callweave.llm import hashing
from callweave.llm.common import fold, run_folder, stored, tidy

#: Bound of the labelled sample that the model is fitted on.
MAX_SAMPLE = 16_000
BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7, 8)
MAX_TERMS = 4096
#: A term is chosen from so many documents and standard deviations on.
MIN_DOCUMENTS = 3
MIN_DEVIATIONS = 4.0
#: The same among the documents with a chosen term, and how many partners there are at most.
PARTNER_DEVIATIONS = 2.5
MAX_PARTNERS = 4096
FACTORS = 8
EPOCHS = 30
THRESHOLD = 0.3

#: Words are runs of ASCII letters and of bytes beyond ASCII.
_BREAKS = np.ones(256, bool)
_BREAKS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class Model:
    """``slots`` maps a bucket to a term number or -1; score is the logistic of the machine."""

    slots: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        linear = self.bias + np.bincount(rows, self.weights[terms], n)
        for k in range(self.vectors.shape[1]):
            own = self.vectors[terms, k]
            linear += (np.bincount(rows, own, n) ** 2 - np.bincount(rows, own**2, n)) / 2
        return 1 / (1 + np.exp(-np.clip(linear, -30, 30)))


def term_buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text numbers and buckets of all words and word beginnings."""
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data).astype(np.uint8)
    inside = ~_BREAKS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    prefix = hashing.prefix_hashes(data)
    rows = np.searchsorted(offsets, starts, "right") - 1
    mask = np.uint64(BUCKETS - 1)
    yield rows, (hashing.range_hashes(prefix, starts, ends) & mask).astype(np.int64)
    for length in PREFIXES:
        longer = ends - starts > length
        begin = starts[longer]
        found = hashing.mix(hashing.range_hashes(prefix, begin, begin + length) + np.uint64(1))
        yield rows[longer], (found & mask).astype(np.int64)


def _terms(texts: pa.Array, slots: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per chunk of texts: first and last row, and each text's distinct terms."""
    data, offsets = hashing.text_bytes(texts)
    for lo, hi in hashing.chunks(offsets):
        own = offsets[lo : hi + 1] - offsets[lo]
        keys = []
        for rows, buckets in term_buckets(data[offsets[lo] : offsets[hi]], own):
            if slots is not None:
                buckets = slots[buckets]
                rows, buckets = rows[buckets >= 0], buckets[buckets >= 0]
            keys.append(rows * BUCKETS + buckets)
        keys = np.unique(np.concatenate(keys))
        yield lo, hi, keys // BUCKETS, keys % BUCKETS


def _counter(holding: np.ndarray | None = None):
    """Documents and toxic documents per bucket; of those only that hold one of ``holding``."""
    def count(batches):
        totals, seen = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            label = batch.column("toxic").to_numpy(zero_copy_only=False)
            for lo, hi, rows, buckets in _terms(batch.column("text"), None):
                use = np.ones(hi - lo, bool)
                if holding is not None:
                    use = np.bincount(rows[holding[buckets]], minlength=hi - lo) > 0
                toxic = label[lo:hi] == 1
                seen += [use.sum(), (use & toxic).sum()]
                rows, buckets = rows[use[rows]], buckets[use[rows]]
                totals[0] += np.bincount(buckets, minlength=BUCKETS)
                totals[1] += np.bincount(buckets[toxic[rows]], minlength=BUCKETS)
        at = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays(  # -1: all documents
            [pa.array([-1]), pa.array(seen[:1]), pa.array(seen[1:])], ["bucket", "n", "toxic"]
        )
        for start in range(0, len(at), 1 << 16):
            part = at[start : start + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(totals[0][part]), pa.array(totals[1][part])],
                ["bucket", "n", "toxic"],
            )

    return count


def _telling(
    sample: DataFrame, holding: np.ndarray | None, deviations: float, most: int, folder: str, name: str
) -> list:
    """bucket and deviation of the terms whose share of toxic documents is far from the average."""
    counts = stored(
        sample.mapInArrow(_counter(holding), "bucket long, n long, toxic long")
        .groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")),
        folder, name,
    )
    whole = counts.filter("bucket = -1").first()
    if whole is None:
        return []
    share = (whole["toxic"] + 1) / (whole["n"] + 2)
    expected = F.col("n") * share
    deviation = (F.col("toxic") - expected) / F.sqrt(expected * (1 - share))
    return (
        counts.filter((F.col("bucket") >= 0) & (F.col("n") >= MIN_DOCUMENTS))
        .select("bucket", deviation.alias("d")).filter(F.abs("d") >= deviations)
        .orderBy(F.desc(F.abs("d")), "bucket").limit(most).collect()
    )


def _fit(lists: list[np.ndarray], labels: np.ndarray, terms: int) -> tuple:
    """Adagrad over small batches in a fixed order; the sample is bounded."""
    rng = np.random.default_rng(11)
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias = float(np.log(share / (1 - share)))
    weights, vectors = np.zeros(terms), rng.normal(0, 0.02, (terms, FACTORS))
    seen_b, seen_w, seen_v = 1e-6, np.full(terms, 1e-6), np.full((terms, FACTORS), 1e-6)
    sizes = np.array([len(x) for x in lists])
    flat = np.concatenate(lists) if len(lists) else np.zeros(0, np.int64)
    begins = np.cumsum(sizes) - sizes
    for _ in range(EPOCHS):
        order = rng.permutation(len(lists))
        for start in range(0, len(order), 128):
            some = order[start : start + 128]
            n = sizes[some]
            rows = np.repeat(np.arange(len(some)), n)
            at = np.repeat(begins[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            t = flat[at]
            own = vectors[t]
            sums = np.stack([np.bincount(rows, own[:, k], len(some)) for k in range(FACTORS)], 1)
            squares = np.bincount(rows, (own**2).sum(1), len(some))
            out = bias + np.bincount(rows, weights[t], len(some)) + ((sums**2).sum(1) - squares) / 2
            error = 1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[some]
            step_w = np.bincount(t, error[rows], terms) + 1e-3 * weights
            pull = error[rows][:, None] * (sums[rows] - own)
            step_v = np.stack([np.bincount(t, pull[:, k], terms) for k in range(FACTORS)], 1) + 1e-3 * vectors
            seen_w += step_w**2
            seen_v += step_v**2
            seen_b += error.sum() ** 2
            weights -= 0.3 * step_w / np.sqrt(seen_w)
            vectors -= 0.03 * step_v / np.sqrt(seen_v)
            bias -= 0.1 * error.sum() / np.sqrt(seen_b)
    return bias, weights, vectors


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", folder: str | None = None) -> Model:
    """Fit on at most :data:`MAX_SAMPLE` labelled rows, chosen by the hash of their id.

    Rows of fold 2, without a label or without a document are not used. Without any
    usable row, or with one label only, every score is the share of label 1.
    """
    spark, given = docs.sparkSession, folder
    folder = folder or run_folder(spark, "toxicity")
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .filter(fold(F.col("doc_id")) != 2)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_SAMPLE)
    )
    # At most MAX_SAMPLE ids are broadcast; of an id on several rows one text is taken, before
    # anything is shuffled, so the sample has at most as many rows.
    value = F.coalesce(F.col(text), F.lit(""))
    sample = stored(
        docs.select("doc_id", value.alias("text")).join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id").agg(
            F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"),
            F.first("toxic").cast("int").alias("toxic"),
        ).select("text", "toxic"),
        folder, "sample",
    )
    first = _telling(sample, None, MIN_DEVIATIONS, MAX_TERMS, folder, "counts")
    terms = [r["bucket"] for r in first]
    holding = np.zeros(BUCKETS, bool)
    holding[[r["bucket"] for r in first if r["d"] > 0]] = True
    if holding.any():
        partners = _telling(
            sample, holding, PARTNER_DEVIATIONS, MAX_PARTNERS + len(terms), folder, "partner-counts"
        )
        known = set(terms)
        terms += [r["bucket"] for r in partners if r["bucket"] not in known][:MAX_PARTNERS]
    slots = np.full(BUCKETS, -1, np.int16)
    slots[terms] = np.arange(len(terms))

    def chosen_terms(batches):
        for batch in batches:
            lists: list[list[int]] = []
            for lo, hi, rows, found in _terms(batch.column("text"), slots):
                lists += [x.tolist() for x in np.split(found, np.searchsorted(rows, np.arange(1, hi - lo)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists, pa.list_(pa.int32())), batch.column("toxic")], ["terms", "toxic"]
            )

    rows = sample.mapInArrow(chosen_terms, "terms array<int>, toxic int").toArrow()
    if given is None:
        tidy(spark, folder)
    # A fixed order: the same rows give the same model.
    lists = [np.array(x, np.int64) for x in rows.column("terms").to_pylist()]
    labels_ = np.array(rows.column("toxic").to_pylist(), float)
    order = sorted(range(len(lists)), key=lambda i: (labels_[i], lists[i].tolist()))
    bias, weights, vectors = _fit([lists[i] for i in order], labels_[order], len(terms))
    return Model(slots, bias, weights, vectors)


def _scores(texts: pa.Array, model: Model) -> np.ndarray:
    out = np.zeros(len(texts))
    for lo, hi, rows, terms in _terms(texts, model.slots):
        out[lo:hi] = model.score(rows, terms, hi - lo)
    return out


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``__score``; a NULL text scores as an empty one."""
    schema = T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())])

    def scored(batches):
        for batch in batches:
            out = pa.array(_scores(batch.column(text), model))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "__score"])

    return docs.mapInArrow(scored, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted; one row per document, repeated rows too."""
    model = fit(docs, labels, text)
    scored = score(docs.select("doc_id", F.col(text).alias("text")), model)
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"),
        F.col("__score").alias("score"),
        F.when(F.col("__score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that score below :data:`THRESHOLD`, columns as they were."""
    model = fit(docs, labels, text)

    def kept(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), model) < THRESHOLD))

    at = docs.columns.index(text)
    return docs.mapInArrow(kept, docs.schema)
