"""Topic models: one over a corpus, or an independent one per group, all fitted together.

Batch variational inference for every group at once. Documents are packed into
chunks of bounded size, so a group with very many documents is spread over many
tasks; a group's topic weights are one row. A pass joins chunks with weights,
updates each chunk in an Arrow batch, and adds up the contributions by group,
topic and term with an ordinary aggregation. A pass also adds up the variational bound,
so every group may stop at its own convergence. The online fit goes through the documents
in mini-batches instead and moves the weights after each.
"""

from __future__ import annotations

import gc
import pickle
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from callweave.operators.topics import describe_topics
from callweave.operators.vocabulary import doc_term_counts, text_counts, vocabulary_by
from callweave.session import drop_folder, finer_scans, shared_dir, wide_rows
from callweave.sources.sinks import materialize

# Executors get the functions of this module with the job, not from an installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Group column of a model over the whole corpus.
CORPUS = "corpus"

# Fixed values of the inference: start distribution, inner passes, tolerance.
GAMMA_SHAPE = 100.0
INNER_PASSES = 100
TOLERANCE = 1e-3

#: Entries of the count matrix that are taken from an Arrow batch together, and those that
#: are worked on together: about as many as the caches hold.
BLOCK = 1 << 20
PANEL = 32_768

#: Files of the chunks of a batch fit: a chunk each up to so many, and that many at least.
CHUNK_FILES = 96
#: Tasks of an online step on a small batch, and chunks in a file of a large one.
STEP_TASKS = 8
CHUNKS_PER_FILE = 64


@dataclass(frozen=True)
class GroupTopics:
    """Result of :func:`fit_topics_by_group`.

    ``topics``     group, ``topic, term, weight`` (unnormalised)
    ``documents``  group, document key, ``topic0_prob`` and so on
    ``weights``    group and its weights in one array, topic after topic
    ``vocabulary`` group, ``term, total, term_no``
    ``bounds``     group, ``step, bound``: the bound per word before each pass, where it was asked for
    """

    topics: DataFrame
    documents: DataFrame
    weights: DataFrame
    vocabulary: DataFrame
    k: int
    bounds: DataFrame | None = None


def digamma(x: np.ndarray) -> np.ndarray:
    """Digamma by six steps of upward recurrence and its asymptotic series."""
    x = np.asarray(x, dtype=float)
    below = 1.0 / x
    for step in range(1, 6):
        below += 1.0 / (x + step)
    x = x + 6.0
    r = 1.0 / (x * x)
    series = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    return np.log(x) - 0.5 / x - series - below


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function by upward recurrence and its asymptotic series."""
    x = np.array(x, dtype=float)
    shift = np.zeros_like(x)
    while (small := x < 8.0).any():
        shift[small] -= np.log(x[small])
        x[small] += 1.0
    r = 1.0 / (x * x)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / x
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series


def topics_bound(weights: np.ndarray) -> float:
    """What the topics add to the variational bound: prior less entropy of their weights."""
    k, size = weights.shape
    prior, sums = 1.0 / k, weights.sum(axis=1)
    expected = digamma(weights) - digamma(sums)[:, None]
    inner = ((prior - weights) * expected + log_gamma(weights)).sum() - weights.size * log_gamma(prior)
    return float(inner + (log_gamma(prior * size) - log_gamma(sums)).sum())


def exp_expected_log(weights: np.ndarray) -> np.ndarray:
    """``exp(E[log p])`` of Dirichlet rows."""
    return np.exp(digamma(weights) - digamma(weights.sum(axis=1, keepdims=True)))


def _growth(x: np.ndarray) -> np.ndarray:
    """``exp(digamma(x))``: the recurrence as one fraction, and no logarithm."""
    y = x * (x + 5.0)
    below = (2.0 * x + 5.0) * ((3.0 * y + 20.0) * y + 24.0) / (y * (y + 4.0) * (y + 6.0))
    q = 1.0 / (x + 6.0)
    r = q * q
    series = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    return (x + 6.0) * np.exp(-(below + 0.5 * q + series))


def _theta(gamma: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """``exp(E[log theta])`` of the documents' topic weights."""
    # Panels have few documents, so that the number of calls counts.
    both = np.empty((len(gamma), len(ones) + 1))
    both[:, :-1], both[:, -1] = gamma, gamma @ ones
    both = _growth(both)
    return both[:, :-1] / both[:, -1:]


def infer(
    doc: np.ndarray, term: np.ndarray, count: np.ndarray, beta: np.ndarray, n_docs: int
) -> tuple[np.ndarray, np.ndarray]:
    """Topic weights of documents given ``beta = exp(E[log p(term|topic)])``.

    ``doc, term, count`` are the entries of a sparse count matrix. Every
    document stops at its own convergence, so the result does not depend on
    which documents share a chunk. Returns the weights per document and
    ``exp(E[log theta])``.

    Documents of about the same number of entries are put into a panel, filled up with
    entries that count nothing, of a size that the caches hold.
    """
    k, prior = beta.shape[0], 1.0 / beta.shape[0]
    ones = np.ones(k)
    if (doc[1:] < doc[:-1]).any():
        order = np.argsort(doc, kind="stable")
        doc, term, count = doc[order], term[order], count[order]
    found = np.full((2, n_docs, k), prior)
    found[1] = _theta(found[0], ones)
    first = np.flatnonzero(np.append(len(doc) > 0, doc[1:] != doc[:-1]))
    lengths = np.diff(np.append(first, len(doc)))
    by_length = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(by_length):
        width = int(lengths[by_length[at]])
        own = by_length[at : at + max(1, PANEL // width)]
        at += len(own)
        there = np.arange(width) < lengths[own][:, None]
        place = np.where(there, first[own][:, None] + np.arange(width), 0)
        counts = np.where(there, count[place], 0.0)[:, None]
        entry_beta = np.ascontiguousarray(beta[:, term[place]].transpose(1, 0, 2))
        _infer_panel(doc[first[own]], counts, entry_beta, found, ones)
    return found[0], found[1]


def _infer_panel(
    ids: np.ndarray, counts: np.ndarray, entry_beta: np.ndarray, found: np.ndarray, ones: np.ndarray
) -> None:
    """The documents ``ids`` of a panel: their counts (documents, 1, entries) and the topics'
    probabilities of these entries (documents, topics, entries). Writes into ``found``."""
    k = len(ones)
    eps = np.finfo(float).eps
    gamma = np.ones((len(ids), k))
    theta = _theta(gamma, ones)
    active = np.ones(len(ids), dtype=bool)
    for step in range(INNER_PASSES):
        ratio = np.matmul(theta[:, None, :], entry_beta)
        ratio += eps
        np.divide(counts, ratio, out=ratio)
        updated = theta * np.matmul(entry_beta, ratio.transpose(0, 2, 1))[:, :, 0] + 1.0 / k
        change = np.abs(updated - gamma) @ ones / k
        gamma, theta = updated, _theta(updated, ones)
        done = active & ((change < TOLERANCE) | (step == INNER_PASSES - 1))
        if not done.any():
            continue
        found[0][ids[done]], found[1][ids[done]] = gamma[done], theta[done]
        active &= ~done
        left = active.sum()
        if not left:
            break
        if left < 0.9 * len(ids):  # drop the entries of finished documents
            ids, counts, entry_beta = ids[active], counts[active], entry_beta[active]
            gamma, theta = gamma[active], theta[active]
            active = np.ones(left, dtype=bool)


def contributions(
    doc: np.ndarray, term: np.ndarray, count: np.ndarray, weights: np.ndarray
) -> tuple[np.ndarray, np.ndarray, float]:
    """Terms of a chunk, what its documents add to each topic's weight of them, and what they
    add to the variational bound."""
    beta = exp_expected_log(weights)
    k, n_docs = beta.shape[0], int(doc.max()) + 1
    gamma, theta = infer(doc, term, count, beta, n_docs)
    expected = theta[doc].T * beta[:, term]
    whole = expected.sum(axis=0) + np.finfo(float).eps
    ratio = count / whole
    terms = np.flatnonzero(np.bincount(term, minlength=beta.shape[1]))
    added = np.stack([np.bincount(term, ratio * row, beta.shape[1])[terms] for row in expected])
    log_theta = digamma(gamma) - digamma(gamma.sum(axis=1))[:, None]
    prior = 1.0 / k
    bound = (count * np.log(whole)).sum() + ((prior - gamma) * log_theta + log_gamma(gamma)).sum()
    bound += n_docs * (log_gamma(1.0) - k * log_gamma(prior)) - log_gamma(gamma.sum(axis=1)).sum()
    return terms, added, float(bound)


def _pack(
    counts: DataFrame,
    vocab: DataFrame,
    sizes: DataFrame,
    group: str,
    key: str,
    docs_per_chunk: int,
    files: int | None = None,
) -> DataFrame:
    """Chunks of a group's documents, with the group's own vocabulary: arrays ``doc, term_no,
    cnt`` of bounded length. ``sizes`` has the group's number of documents."""
    rows = counts.join(vocab.select(group, "term", "term_no"), [group, "term"])
    pieces = F.ceil(F.col("__docs") / docs_per_chunk)
    return _gathered(rows.join(sizes, group), pieces, group, key, files).drop("chunk")


def _terms_column(terms: DataFrame) -> str:
    return "terms" if "terms" in terms.columns else "term"


def _counted(terms: DataFrame, group: str, key: str, work: str) -> tuple[DataFrame, DataFrame]:
    """Written counts per document and term, and rows that add up to a term's count in its group."""
    if _terms_column(terms) == "term":
        counts = materialize(doc_term_counts(terms, [group, key]), f"{work}/counts")
        return counts, counts
    found = materialize(text_counts(terms, group, key), f"{work}/counts")
    pairs = F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("cnts").alias("cnt")))
    counts = found.filter("cnt is null").select(group, key, pairs)
    return counts, found.filter("cnt is not null").select(group, "term", "cnt")


def _sizes(documents: DataFrame, group: str) -> DataFrame:
    return documents.groupBy(group).agg(F.count("*").alias("__docs"))


def _files(sizes: DataFrame, docs_per_chunk: int) -> int:
    """Files of the chunks: adaptive execution would see a small table in them and put it
    into one file or a few, and that many tasks would do all passes."""
    pieces = sizes.agg(F.sum(F.ceil(F.col("__docs") / docs_per_chunk))).first()[0] or 1
    return int(max(min(CHUNK_FILES, pieces), pieces // CHUNKS_PER_FILE))


def _gathered(
    rows: DataFrame, pieces: Column, group: str, key: str, files: int | None = None
) -> DataFrame:
    """The rows of a group's documents in so many ``pieces``; a document's entries stand together."""
    entries = F.collect_list(F.struct(F.col(key).alias("doc"), "term_no", "cnt"))
    placed = rows.select(group, F.pmod(F.xxhash64(key), pieces).alias("chunk"), key, "term_no", "cnt")
    if files is not None:
        placed = placed.repartition(files, group, "chunk")
    return (
        placed.groupBy(group, "chunk")
        .agg(F.sort_array(entries).alias("e"))
        .select(
            group,
            "chunk",
            F.col("e.doc").alias("doc"),
            F.col("e.term_no").alias("term_no"),
            F.col("e.cnt").alias("cnt"),
        )
    )


def _first_weights(vocab: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """Random start weights, the same for groups of equal vocabulary size."""

    @F.pandas_udf("array<double>")
    def draw(sizes: pd.Series) -> pd.Series:
        return sizes.map(
            lambda n: np.random.RandomState(seed)
            .gamma(GAMMA_SHAPE, 1.0 / GAMMA_SHAPE, (k, n))
            .ravel()
        )

    sizes = vocab.groupBy(group).agg(F.count("*").cast("int").alias("__size"))
    return sizes.select(group, draw("__size").alias("weights"))


def _blocks(batch: pd.DataFrame, group: str, k: int) -> Iterator[tuple]:
    """The chunks of a batch, those of one group put together up to :data:`BLOCK` entries: group,
    document keys, then document number, term and count of the entries, and the weights."""
    for name, own in batch.groupby(group, sort=False, dropna=False):
        ends = own["cnt"].map(len).cumsum()
        weights = np.asarray(own["weights"].iloc[0]).reshape(k, -1)
        for _, rows in own.groupby((ends - 1) // BLOCK, sort=False):
            doc, term, count = (np.concatenate(rows[c].to_list()) for c in ("doc", "term_no", "cnt"))
            starts = np.append(len(doc) > 0, (doc[1:] != doc[:-1]) & ~(pd.isna(doc[1:]) & pd.isna(doc[:-1])))
            yield name, doc[starts], np.cumsum(starts) - 1, term, count.astype(float), weights


def _added(chunks: DataFrame, weights: DataFrame, group: str, k: int) -> DataFrame:
    """What the chunks add to their group's weights: group, ``topic, term_no, added``.

    Topic -1 has what they add to the bound.
    """
    joined = chunks.join(weights.select(group, "weights"), group)
    kind = chunks.schema[group].dataType.simpleString()

    def rows(sums: dict) -> Iterator[pd.DataFrame]:
        for name, (own, met, bound) in sums.items():
            # Every entry of the terms met, also one that rounds to 0.
            terms = np.flatnonzero(met)
            yield pd.DataFrame(
                {
                    group: [name] * (k * len(terms) + 1),
                    "topic": np.append(np.repeat(np.arange(k), len(terms)), -1),
                    "term_no": np.append(np.tile(terms, k), -1),
                    "added": np.append(own[:, terms].ravel(), bound),
                }
            )

    def update(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # One sum per group, kept over the batches of a task up to so many weights.
        sums: dict = {}
        for batch in batches:
            for name, _, doc, term, count, current in _blocks(batch, group, k):
                terms, added, bound = contributions(doc, term, count, current)
                own = sums.setdefault(
                    name, [np.zeros_like(current, dtype=float), np.zeros(current.shape[1], bool), 0.0]
                )
                own[0][:, terms] += added
                own[1][terms] = True
                own[2] += bound
            if sum(own[0].size for own in sums.values()) > BLOCK:
                yield from rows(sums)
                sums = {}
        yield from rows(sums)

    parts = joined.mapInPandas(
        update, f"{group} {kind}, topic int, term_no int, added double"
    )
    return parts.groupBy(group, "topic", "term_no").agg(F.sum("added").alias("added"))


def _pass(chunks: DataFrame, weights: DataFrame, group: str, k: int) -> DataFrame:
    """New weights of every group after one pass over its documents, and the documents' part
    of the bound at the weights before it."""
    prior = 1.0 / k
    entry = F.struct("topic", "term_no", F.col("added") + prior)
    ordered = F.array_sort(F.collect_list(F.when(F.col("topic") >= 0, entry)))
    return _added(chunks, weights, group, k).groupBy(group).agg(
        F.transform(ordered, lambda s: s["col3"]).alias("weights"),
        F.max(F.when(F.col("topic") < 0, F.col("added"))).alias("seen"),
    )


@F.pandas_udf(T.DoubleType())
def _topics_bound(weights: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([
        topics_bound(np.asarray(w, float).reshape(n, -1)) for w, n in zip(weights, k)
    ], dtype=float)


def _with_bound(after: DataFrame, before: DataFrame, words: DataFrame, group: str, k: int) -> DataFrame:
    """A pass's weights with the bound per word at the weights before it, and its rise."""
    last = before.select(
        group, _topics_bound("weights", F.lit(k)).alias("__topics"), F.col("bound").alias("__last")
    )
    bound = (F.col("seen") + F.col("__topics")) / F.col("words")
    return (
        after.join(last, group).join(words, group)
        .withColumn("bound", bound).withColumn("change", F.col("bound") - F.col("__last"))
        .select(group, "weights", "bound", "change")
    )


def _distributions(
    chunks: DataFrame, weights: DataFrame, group: str, key: str, k: int
) -> DataFrame:
    joined = chunks.join(weights, group)
    fields = {f.name: f.dataType.simpleString() for f in chunks.schema}
    doc_kind = chunks.schema["doc"].dataType.elementType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, ids, doc, term, count, current in _blocks(batch, group, k):
                gamma, _ = infer(doc, term, count, exp_expected_log(current), len(ids))
                probs = gamma / gamma.sum(axis=1, keepdims=True)
                yield pd.DataFrame(
                    {
                        group: [name] * len(ids),
                        key: ids,
                        **{f"topic{i}_prob": probs[:, i] for i in range(k)},
                    }
                )

    columns = ", ".join(f"topic{i}_prob double" for i in range(k))
    return joined.mapInPandas(score, f"{group} {fields[group]}, {key} {doc_kind}, {columns}")


def fit_topics_by_group(
    terms: DataFrame,
    group: str,
    key: str,
    k: int = 2,
    seed: int = 0,
    max_iter: int = 10,
    max_features: int = 1000,
    docs_per_chunk: int = 64,
    documents: DataFrame | None = None,
    work_dir: str | None = None,
    tolerance: float | None = None,
) -> GroupTopics:
    """Fit a topic model of its own, with its own vocabulary, for every group.

    ``terms`` has a row per text with its terms as an array (``group, key, terms``), or a row
    per term occurrence (``group, key, term``). Arrays are counted where they are made; rows
    are shuffled for it. ``documents`` lists all documents (``group, key``): those without a
    known term belong to all topics alike.

    Counts, chunks and the weights after each pass are written to ``work_dir``, by
    default below the shared folder of the session: each pass starts from
    files, and a lost executor costs part of one pass. The weights' size on file
    decides whether Spark broadcasts them or joins by shuffle.

    With ``tolerance`` a group stops once a pass has changed its variational bound per word
    by less; it leaves the join, and once half of the groups left have stopped the
    chunks of the others are written anew, so that those of stopped groups are read no more.
    """
    spark = terms.sparkSession
    work = work_dir or f"{shared_dir(spark)}/group-topics-{uuid.uuid4().hex}"
    by_term = Window.partitionBy(group).orderBy("term")
    counts, totals = _counted(terms, group, key, work)
    listed = documents if documents is not None else counts.select(group, key).distinct()
    vocab = materialize(
        vocabulary_by(totals, group, max_features, "cnt").withColumn(
            "term_no", F.row_number().over(by_term) - 1
        ),
        f"{work}/vocabulary",
    )
    sizes = materialize(_sizes(listed, group), f"{work}/sizes")
    chunks = materialize(
        _pack(counts, vocab, sizes, group, key, docs_per_chunk, _files(sizes, docs_per_chunk)),
        f"{work}/chunks",
    )
    weights = materialize(_first_weights(vocab, group, k, seed), f"{work}/weights-0")
    bounds = None
    with finer_scans(spark), wide_rows(spark, docs_per_chunk):
        if tolerance is None:
            for step in range(1, max_iter + 1):
                passed = _pass(chunks, weights, group, k).drop("seen")
                weights = materialize(passed, f"{work}/weights-{step}")
                drop_folder(spark, f"{work}/weights-{step - 1}")
        else:
            weights, bounds = _until_settled(chunks, weights, group, k, max_iter, tolerance, work)
        scored = materialize(_distributions(chunks, weights, group, key, k), f"{work}/documents")
    for done in ("counts", "chunks", "sizes"):
        drop_folder(spark, f"{work}/{done}")
    if documents is not None:
        scored = _all_documents(documents, scored, group, key, k)
    return GroupTopics(_named_terms(weights, vocab, group), scored, weights, vocab, k, bounds)


def _until_settled(
    chunks: DataFrame, weights: DataFrame, group: str, k: int, max_iter: int, tolerance: float, work: str
) -> tuple[DataFrame, DataFrame]:
    """Weights of every group at its own last pass, and the bounds per group and step."""
    counted = F.aggregate("cnt", F.lit(0).cast("long"), lambda a, c: a + c)
    words = materialize(
        chunks.groupBy(group).agg(F.sum(counted).alias("words")), f"{work}/words"
    )
    active = weights.withColumn("bound", F.lit(None).cast("double"))
    listed = active.count()
    done, bounds = None, None
    for step in range(1, max_iter + 1):
        passed = _with_bound(_pass(chunks, active, group, k), active, words, group, k)
        passed = materialize(passed, f"{work}/weights-{step}")
        told = passed.select(group, F.lit(step - 1).alias("step"), "bound")
        bounds = told if bounds is None else bounds.union(told)
        settled = F.coalesce(F.abs("change") < tolerance, F.lit(False)) | F.lit(step == max_iter)
        ended = passed.filter(settled).select(group, "weights")
        done = ended if done is None else done.union(ended)
        active = passed.filter(~settled).select(group, "weights", "bound")
        left = active.count()
        if not left:
            break
        if left <= listed // 2:
            listed = left
            chunks = materialize(
                chunks.join(active.select(group), group, "left_semi"), f"{work}/chunks-{step}"
            )
    return done, bounds


def fit_topics_online(
    terms: DataFrame,
    key: str,
    k: int = 3,
    seed: int = 0,
    passes: int = 50,
    batch_docs: int = 2000,
    offset: float = 1.0,
    decay: float = 0.5,
    max_features: int = 1000,
    documents: DataFrame | None = None,
    docs_per_chunk: int = 64,
    work_dir: str | None = None,
) -> GroupTopics:
    """One topic model over the whole corpus by online variational inference.

    The documents are dealt into mini-batches of about ``batch_docs`` by the hash of their
    key; a pass goes through all of them in order, so every document counts once a
    pass. After batch t the weights move towards what that batch alone would give, by the step
    ``(offset + t) ** -decay``. ``terms``, ``documents`` and the result are as in
    :func:`fit_topics`.

    A step reads no other batch than its own and is one job without a query plan or a shuffle:
    the chunks are dealt out by batch once and stay where the executors keep shuffled data (a
    lost part is made again from files), tasks get the weights with their function, and the
    driver moves them by the sums that come back. It holds ``k * max_features`` numbers and as
    many per task. A single batch is read from files at every step.
    """
    spark = terms.sparkSession
    work = work_dir or f"{shared_dir(spark)}/online-topics-{uuid.uuid4().hex}"
    whole = F.lit(0).alias(CORPUS)
    counts, totals = _counted(terms.select(whole, key, _terms_column(terms)), CORPUS, key, work)
    listed = documents.select(whole, key) if documents is not None else counts.select(CORPUS, key).distinct()
    vocab = materialize(
        vocabulary_by(totals, CORPUS, max_features, "cnt").withColumn(
            "term_no", F.row_number().over(Window.partitionBy(CORPUS).orderBy("term")) - 1
        ),
        f"{work}/vocabulary",
    )
    n_docs = listed.count()
    batches = max(1, -(-n_docs // batch_docs))
    number = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(batches)).cast("int")
    sizes = {r["batch"]: r["n"] for r in listed.groupBy(number.alias("batch")).agg(F.count("*").alias("n")).collect()}
    known = counts.join(vocab.select("term", "term_no"), "term").withColumn("batch", number)
    # The hash deals batches of about equal size, so that all have the same number of chunks.
    pieces = -(-n_docs // (batches * docs_per_chunk)) or 1
    files = max(min(CHUNK_FILES, batches * pieces), batches * pieces // CHUNKS_PER_FILE)
    packed = _gathered(known, F.lit(pieces), "batch", key, files)
    chunks = materialize(packed.withColumn(CORPUS, whole), f"{work}/chunks")
    # A batch is read by several tasks, and by more of them the more chunks it has.
    tasks = max(min(STEP_TASKS, pieces), pieces // CHUNKS_PER_FILE)
    current = np.random.RandomState(seed).gamma(GAMMA_SHAPE, 1.0 / GAMMA_SHAPE, (k, vocab.count()))
    step = 0
    with wide_rows(spark, docs_per_chunk):
        held = _held(chunks, batches, tasks) if batches > 1 else None
        for _ in range(passes):
            for batch in sorted(sizes):
                step += 1
                rate = (offset + step) ** -decay
                if held is None:
                    own = _sums(chunks, current)
                else:
                    own = _step_sums(held, range(batch * tasks, (batch + 1) * tasks), current)
                current = (1 - rate) * current + rate * (1.0 / k + n_docs / sizes[batch] * own)
        last = spark.createDataFrame([(0, current.ravel().tolist())], f"{CORPUS} int, weights array<double>")
        weights = materialize(last.filter(F.size("weights") > 0), f"{work}/weights")
        scored = materialize(
            _distributions(chunks.drop("batch", "chunk"), weights, CORPUS, key, k), f"{work}/documents"
        )
    for done in ("counts", "chunks"):
        drop_folder(spark, f"{work}/{done}")
    if documents is not None:
        scored = _all_documents(listed, scored, CORPUS, key, k)
    return GroupTopics(_named_terms(weights, vocab, CORPUS), scored, weights, vocab, k)


def _held(chunks: DataFrame, batches: int, tasks: int) -> RDD:
    """The chunks without their documents' keys, partition ``batch * tasks + i`` for each of the
    ``tasks`` of a batch: number of the chunk, entries of its documents, terms and counts."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            parts, data = [], []
            for number, chunk, *lists in zip(*(rows.column(c) for c in names)):
                doc, term, count = (x.values for x in lists)
                doc = doc.dictionary_encode(null_encoding="encode").indices.to_numpy()
                lengths = np.diff(np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc)))
                arrays = (x.astype(np.min_scalar_type(x.max())) for x in (lengths, term.to_numpy(), count.to_numpy()))
                parts.append(number.as_py() * tasks + chunk.as_py() % tasks)
                data.append(pickle.dumps((chunk.as_py(), *arrays)))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(data, pa.binary())], ["part", "data"])

    names = ["batch", "chunk", "doc", "term_no", "cnt"]
    encoded = chunks.select(*names).mapInArrow(encode, "part long, data binary")
    return encoded.rdd.map(tuple).partitionBy(batches * tasks, int)


def _settle() -> None:
    """Sets what a Python worker has loaded aside, once: after every task it looks through all
    of its objects for garbage, which takes longer than a step."""
    if not hasattr(sys, "_callweave_settled"):
        gc.collect()
        gc.freeze()
        sys._callweave_settled = True


def _step_sums(held: RDD, parts: Sequence[int], weights: np.ndarray) -> np.ndarray:
    """What the chunks in these partitions add to the weights, by one job."""

    def update(rows: Iterator[tuple]) -> Iterator[np.ndarray]:
        _settle()
        added = np.zeros_like(weights)
        block, size = [], 0
        # Shuffled rows come in any order.
        for chunk in [*sorted((pickle.loads(data) for _, data in rows), key=lambda c: c[0]), None]:
            if block and (chunk is None or size + len(chunk[2]) > BLOCK):
                lengths, term, count = (np.concatenate([c[i] for c in block]) for i in (1, 2, 3))
                doc = np.repeat(np.arange(len(lengths)), lengths)
                terms, own, _ = contributions(doc, term, count.astype(float), weights)
                added[:, terms] += own
                block, size = [], 0
            if chunk is not None:
                block.append(chunk)
                size += len(chunk[2])
        yield added

    return sum(held.context.runJob(held, update, parts), np.zeros_like(weights))


def _sums(chunks: DataFrame, weights: np.ndarray) -> np.ndarray:
    """What the chunks of a corpus add to its weights, by one job: a row per task comes back, in
    the order of the tasks."""
    k = len(weights)

    def update(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        added = np.zeros_like(weights)
        for batch in batches:
            batch["weights"] = [weights] * len(batch)
            for _, _, doc, term, count, current in _blocks(batch, CORPUS, k):
                terms, own, _ = contributions(doc, term, count, current)
                added[:, terms] += own
        yield pd.DataFrame({"added": [added.ravel()]})

    rows = chunks.select(CORPUS, "doc", "term_no", "cnt").mapInPandas(update, "added array<double>")
    return sum((np.asarray(r["added"]).reshape(k, -1) for r in rows.collect()), np.zeros_like(weights))


def fit_topics(
    terms: DataFrame,
    key: str,
    k: int = 5,
    seed: int = 0,
    max_iter: int = 10,
    max_features: int = 1000,
    documents: DataFrame | None = None,
    work_dir: str | None = None,
    tolerance: float | None = None,
) -> GroupTopics:
    """One topic model over the whole corpus by the same batch inference.

    ``terms`` has a row per text (``key, terms``) or per term occurrence (``key, term``).
    Every pass uses every document. The corpus is one group, named :data:`CORPUS` in the result.
    """
    whole = F.lit(0).alias(CORPUS)
    return fit_topics_by_group(
        terms.select(whole, key, _terms_column(terms)), CORPUS, key, k, seed, max_iter, max_features,
        documents=None if documents is None else documents.select(whole, key),
        work_dir=work_dir, tolerance=tolerance,
    )


def topic_distribution(
    fitted: GroupTopics, terms: DataFrame, group: str, key: str,
    documents: DataFrame | None = None, docs_per_chunk: int = 256,
) -> DataFrame:
    """Topic probabilities of documents, also of ones the model was not fitted on."""
    counts = doc_term_counts(terms, [group, key])
    listed = documents if documents is not None else counts.select(group, key).distinct()
    chunks = _pack(counts, fitted.vocabulary, _sizes(listed, group), group, key, docs_per_chunk)
    scored = _distributions(chunks, fitted.weights, group, key, fitted.k)
    return _all_documents(listed, scored, group, key, fitted.k)


def _all_documents(
    documents: DataFrame, scored: DataFrame, group: str, key: str, k: int
) -> DataFrame:
    """Documents without a known term belong to all topics alike."""
    names = [f"topic{i}_prob" for i in range(k)]
    return documents.select(group, key).join(scored, [group, key], "left").fillna(
        1.0 / k, subset=names
    )


def _named_terms(weights: DataFrame, vocab: DataFrame, group: str) -> DataFrame:
    """Weights as a long table with the terms in words."""
    size = vocab.groupBy(group).agg(F.count("*").cast("int").alias("__size"))
    flat = weights.join(size, group).select(
        group, "__size", F.posexplode("weights").alias("__at", "weight")
    )
    placed = flat.select(
        group,
        F.floor(F.col("__at") / F.col("__size")).cast("int").alias("topic"),
        (F.col("__at") % F.col("__size")).alias("term_no"),
        "weight",
    )
    return placed.join(vocab.select(group, "term", "term_no"), [group, "term_no"]).select(
        group, "topic", "term", "weight"
    )


def attach_topics(
    calls: DataFrame, fitted: GroupTopics, group: str, key: str, n: int = 10
) -> DataFrame:
    """Calls with their topic probabilities and the top words of their group's topics.

    Probabilities are ``topic0_prob`` and so on, words ``topic0_words`` and so on. No call
    is lost: without known terms it belongs to all topics alike, and where its group has
    no vocabulary the words are NULL.
    """
    k = fitted.k
    texts = describe_topics(fitted.topics, n, "words", [group])
    wide = texts.groupBy(group).agg(
        *[
            F.max(F.when(F.col("topic") == i, F.col("description"))).alias(f"topic{i}_words")
            for i in range(k)
        ]
    )
    names = [f"topic{i}_prob" for i in range(k)]
    return (
        calls.join(fitted.documents, [group, key], "left")
        .fillna(1.0 / k, subset=names)
        .join(wide, group, "left")
    )
