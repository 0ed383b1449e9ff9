"""Vocabulary and document-term counts, as long tables."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from callweave.session import shared_dir
from callweave.sources.sinks import materialize

# Executors get the functions of this module with the job, not from an installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def term_rows(
    df: DataFrame, keys: Sequence[str], terms: Column, stopwords: Sequence[str] = ()
) -> DataFrame:
    """One row per term occurrence: the keys and ``term``."""
    rows = df.select(*keys, F.explode(terms).alias("term"))
    return rows.filter(~F.col("term").isin(list(stopwords))) if stopwords else rows


def _total(count: str | None) -> Column:
    return (F.count("*") if count is None else F.sum(count)).alias("total")


def vocabulary(
    terms: DataFrame, max_features: int | None = 1000, count: str | None = None
) -> DataFrame:
    """Terms with their corpus count, the most frequent ones: ``term, total``.

    ``count`` names the column of counts where the rows are not occurrences.
    Equal totals are decided by the term.
    """
    totals = terms.groupBy("term").agg(_total(count))
    if max_features is None:
        return totals
    return totals.orderBy(F.col("total").desc(), "term").limit(max_features)


def vocabulary_by(
    terms: DataFrame, group: str, max_features: int = 1000, count: str | None = None
) -> DataFrame:
    """A vocabulary of its own per group: ``group, term, total``."""
    totals = terms.groupBy(group, "term").agg(_total(count))
    best = Window.partitionBy(group).orderBy(F.col("total").desc(), "term")
    return (
        totals.withColumn("__rank", F.row_number().over(best))
        .filter(F.col("__rank") <= max_features)
        .drop("__rank")
    )


def doc_term_counts(
    terms: DataFrame, keys: Sequence[str], vocab: DataFrame | None = None
) -> DataFrame:
    """Counts per document and term: keys, ``term, cnt``.

    Occurrences are counted before they meet the vocabulary. A vocabulary may
    be one for all, or one per group when it has a column of the keys.
    """
    counts = terms.groupBy(*keys, "term").agg(F.count("*").alias("cnt"))
    return counts if vocab is None else known_terms(counts, vocab, keys)


#: Sums of a task that are put together, and sent on if they are still half as many.
SUMS = 1 << 20


def text_counts(df: DataFrame, group: str, key: str, terms: str = "terms") -> DataFrame:
    """The counts of :func:`doc_term_counts` and what :func:`vocabulary_by` adds up, by one
    look at each text and without a shuffle of either.

    ``df`` has a row per text with its ``terms`` as an array. A text is a row ``group, key,
    terms, cnts`` of two arrays; rows with ``group, term, cnt`` instead are sums over many texts
    of a task. Texts of one key stay apart. NULL is not a term.
    """
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c in (group, key)]
    texts = df.select(group, key, F.col(terms).cast("array<string>").alias("terms"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            listed = batch.column(2)
            coded = listed.flatten().dictionary_encode()
            there = coded.indices.is_valid().to_numpy(zero_copy_only=False)
            parent = pc.list_parent_indices(listed).to_numpy()[there]
            codes = coded.indices.drop_null().to_numpy().astype(np.int64)
            size = max(len(coded.dictionary), 1)
            pairs, cnt = np.unique(parent * size + codes, return_counts=True)
            text, code = np.divmod(pairs, size)
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            arrays = [
                pa.ListArray.from_arrays(pa.array(ends), values)
                for values in (coded.dictionary.take(pa.array(code)), pa.array(cnt.astype(np.int64)))
            ]
            nothing = [pa.nulls(batch.num_rows, pa.string()), pa.nulls(batch.num_rows, pa.int64())]
            yield _row_batch([group, key], batch.column(0), batch.column(1), *arrays, *nothing)
            owner = batch.column(0).dictionary_encode(null_encoding="encode")
            pairs, where = np.unique(owner.indices.to_numpy()[text] * size + code, return_inverse=True)
            own, code = np.divmod(pairs, size)
            held.append(pa.table({
                "group": owner.dictionary.take(pa.array(own)),
                "term": coded.dictionary.take(pa.array(code)),
                "cnt": np.bincount(where, cnt, len(pairs)).astype(np.int64),
            }))
            rows += len(pairs)
            if rows > SUMS:
                held = [_summed(held)]
                rows = len(held[0])
                if rows > SUMS // 2:
                    yield from _sum_rows([group, key], held[0], batch.schema.field(1).type)
                    held, rows = [], 0
        if held:
            yield from _sum_rows([group, key], _summed(held), batch.schema.field(1).type)

    return texts.mapInArrow(
        count, ", ".join([*kinds, "terms array<string>, cnts array<long>, term string, cnt long"])
    )


def _row_batch(names: Sequence[str], group, key, terms, cnts, term, cnt) -> pa.RecordBatch:
    named = {"terms": terms, "cnts": cnts, "term": term, "cnt": cnt}
    return pa.RecordBatch.from_arrays([group, key, *named.values()], [*names, *named])


def _summed(tables: list[pa.Table]) -> pa.Table:
    whole = pa.concat_tables(tables).group_by(["group", "term"]).aggregate([("cnt", "sum")])
    return whole.select(["group", "term", "cnt_sum"]).rename_columns(["group", "term", "cnt"])


def _sum_rows(names: Sequence[str], sums: pa.Table, key: pa.DataType) -> Iterator[pa.RecordBatch]:
    for part in sums.to_batches(max_chunksize=65_536):
        n = part.num_rows
        nothing = [pa.nulls(n, key), pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.int64()))]
        yield _row_batch(names, part.column(0), *nothing, part.column(1), part.column(2))


def known_terms(counts: DataFrame, vocab: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of the terms in the vocabulary."""
    on = [c for c in vocab.columns if c in keys] + ["term"]
    return counts.join(vocab.select(*on), on, "left_semi").select(*keys, "term", "cnt")


def term_matrix(
    terms: DataFrame, keys: Sequence[str], max_features: int = 1000, group: str | None = None
) -> DataFrame:
    """Counts over the most frequent terms, of the corpus or of each ``group``.

    The vocabulary is made from the counts, so both come from one exchange: the
    texts are read and split once.
    """
    counts = doc_term_counts(terms, keys)
    if group is None:
        vocab = vocabulary(counts, max_features, "cnt")
    else:
        vocab = vocabulary_by(counts, group, max_features, "cnt")
    return known_terms(counts, vocab, keys)


class HeavyTerms:
    """Counts of the most frequent terms of a stream, with a bound on what is missing.

    Beyond four times ``size`` terms only the ``size`` largest counts stay. A term may have
    lost at most the largest count dropped each time, so no count is short by more than
    ``lost``, and no term that is absent occurred more often.
    """

    def __init__(self, size: int):
        self._size = size
        self._terms, self._counts = pa.array([], pa.string()), np.zeros(0, np.int64)
        self.lost = 0

    def add(self, terms: pa.Array) -> None:
        found = pc.value_counts(terms)
        self._terms = pa.concat_arrays([self._terms, found.field("values")])
        self._counts = np.concatenate([self._counts, found.field("counts").to_numpy()])
        if len(self._terms) > 4 * self._size:
            self._merge()
            if len(self._terms) > 2 * self._size:
                self._drop()

    def _merge(self) -> None:
        coded = self._terms.dictionary_encode()
        self._counts = np.bincount(
            coded.indices.to_numpy(), self._counts, len(coded.dictionary)
        ).astype(np.int64)
        self._terms = coded.dictionary

    def _drop(self) -> None:
        order = np.argsort(-self._counts, kind="stable")
        keep, gone = order[: self._size], order[self._size :]
        if len(gone):
            self.lost += int(self._counts[gone].max())
        self._terms, self._counts = self._terms.take(pa.array(keep)), self._counts[keep]

    def result(self) -> tuple[pa.Array, np.ndarray]:
        self._merge()
        if len(self._terms) > self._size:
            self._drop()
        return self._terms, self._counts


def heavy_terms(df: DataFrame, terms: Column, size: int) -> DataFrame:
    """``term, low``: a summary per task, at most ``size`` terms each. The NULL term has what
    any term's count in that task may be short by."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = HeavyTerms(size)
        for batch in batches:
            held.add(batch.column("terms").flatten().drop_null())
        names, counts = held.result()
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([names, pa.array([None], pa.string())]), pa.array(np.append(counts, held.lost))],
            ["term", "low"],
        )

    return df.select(terms.alias("terms")).mapInArrow(summarise, "term string, low long")


def frequent_terms(
    df: DataFrame, terms: Column, max_features: int = 1000, stopwords: Sequence[str] = (),
    size: int = 65_536, work_dir: str | None = None,
) -> DataFrame:
    """The vocabulary of :func:`vocabulary`, exactly, without shuffling every term.

    First every task sends a summary of its most frequent terms. Their sums are counts from
    below, short by at most the sum of what the tasks may have lost. If that sum is below the
    count of the last term asked for, every term that may belong to the vocabulary is among
    those seen; only these are then counted. Otherwise the summaries are made four times
    as long, until they hold all terms if need be. ``terms`` is an array column.
    """
    work = work_dir or f"{shared_dir(df.sparkSession)}/frequent-terms-{uuid.uuid4().hex}"
    step = 0
    while True:
        rows = heavy_terms(df, terms, size)
        summed = materialize(
            rows.groupBy("term").agg(F.sum("low").alias("low")), f"{work}/summary-{step}"
        )
        lost = summed.filter("term is null").agg(F.sum("low")).first()[0] or 0
        known = summed.filter("term is not null")
        if stopwords:
            known = known.filter(~F.col("term").isin(list(stopwords)))
        last = known.orderBy(F.desc("low")).limit(max_features).agg(F.min("low"), F.count("*")).first()
        enough = last[1] == max_features and lost < last[0]
        if enough or not lost:
            break
        size, step = 4 * size, step + 1
    if not lost:  # nothing was dropped anywhere: the sums are the counts
        return known.select("term", F.col("low").alias("total")).orderBy(F.desc("total"), "term").limit(max_features)
    candidates = known.filter(F.col("low") + lost >= last[0]).select("term")
    counted = term_rows(df, [], terms).join(candidates, "term", "left_semi")
    return vocabulary(counted, max_features)
