"""Hard negatives by threshold joins over a partial inverted index.

Anchors and rows are packed into blocks, and every block of anchors meets every block of
rows once. Inside such a pair an inverted index holds, per group of dimensions, the rows
that reach it: a row's last dimensions are left out of the index where the norm of that
suffix alone cannot bring any anchor to the threshold. Scores are accumulated
dimension by dimension, a pair is dropped once the partial score plus the product of the
remaining norms is below the anchor's threshold, and what survives is completed from the
rows themselves. Thresholds start high and are lowered, only for the anchors whose window
is not yet full, until it is full or nothing is left below.

A block gives an anchor at most as many rows as its window holds, so what is merged per
anchor is bounded by the window times the number of blocks, however many rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from callweave.llm.common import run_folder, stored, tidy
from callweave.llm.whitening import usable

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative scores between these hundredths of the positive's score.
WINDOW = (30, 90)
BLOCK_ROWS = 4096
BLOCK_ANCHORS = 2048
#: Anchors of a block that are joined at once, and dimensions accumulated between two prunings.
SLICE_ANCHORS = 256
CHUNK = 8
#: Thresholds as shares of the largest possible score; below the last one all rows count.
LEVELS = (0.7, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0)
#: Below this share of pairs alive they are completed one by one.
SPARSE = 0.05
_NOTHING_BELOW = -np.inf


class Index:
    """Rows of a block, as vectors whose dimensions come in falling energy."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.norms = suffix_norms(x)

    def join(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and score of all pairs that score ``least[anchor]`` or more."""
        chunks = self.norms.shape[1] - 1
        own = suffix_norms(q)
        # Where the suffix alone cannot reach the least threshold, it is not indexed.
        reach = float(own[:, 0].max(initial=0.0))
        slack = 0.5 + 1e-12 * reach * float(self.norms[:, 0].max(initial=0.0))
        indexed = (self.norms[:, :chunks] * reach >= float(least.min(initial=np.inf)) - slack).sum(axis=1)
        order = np.argsort(-indexed, kind="stable")
        indexed, rows = indexed[order], order
        anchors = np.arange(len(q))
        x, norms = self.x[order], self.norms[order]
        score = np.zeros((len(q), len(x)), x.dtype)
        alive = np.broadcast_to(indexed > 0, score.shape).copy()
        for k in range(chunks):
            span = slice(k * CHUNK, (k + 1) * CHUNK)
            have = int(np.searchsorted(-indexed, -k, "left"))  # rows whose list reaches this chunk
            if not have:
                break
            score[:, :have] += q[anchors, span] @ x[:have, span].T
            # Rows whose index ended before keep the bound of their suffix.
            bound = score[:, :have] + own[anchors, k + 1][:, None] * norms[:have, k + 1]
            alive[:, :have] &= bound >= least[anchors, None] - slack
            if alive.mean() < SPARSE:
                return self._complete(q, least, anchors, rows, alive)
            some = alive.any(axis=0)
            if some.mean() < 0.6:
                rows, indexed, x, norms = rows[some], indexed[some], x[some], norms[some]
                score, alive = score[:, some], alive[:, some]
            some = alive.any(axis=1)
            if some.mean() < 0.6:
                anchors, score, alive = anchors[some], score[some], alive[some]
        return self._complete(q, least, anchors, rows, alive)

    def _complete(self, q, least, anchors, rows, alive):
        """Exact scores of the pairs that are left."""
        at, place = np.nonzero(alive)
        a, r = anchors[at], rows[place]
        parts = [
            np.einsum("ij,ij->i", q[a[k : k + 65536]], self.x[r[k : k + 65536]])
            for k in range(0, len(a), 65536)
        ]
        score = np.concatenate(parts) if parts else np.zeros(0, self.x.dtype)
        keep = score >= least[a]
        return a[keep], r[keep], score[keep]


def suffix_norms(x: np.ndarray) -> np.ndarray:
    """Norm of what follows each group of dimensions; the last column is 0."""
    squares = x.astype(float) ** 2
    ends = range(0, x.shape[1], CHUNK)
    sums = np.stack([squares[:, k : k + CHUNK].sum(axis=1) for k in ends], axis=1)
    rest = np.cumsum(sums[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([rest, np.zeros((len(x), 1))], axis=1))


def _best(place: np.ndarray, score: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """Positions of the first ``n`` per group in the order of score (falling) and rank."""
    order = np.lexsort((rank, -score, place))
    group = place[order]
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else group
    sizes = np.diff(np.append(begin, len(group)))
    within = np.arange(len(group)) - np.repeat(begin, sizes)
    return order[within < n]


def nearest_alike(index: Index, q: np.ndarray, wanted: np.ndarray, same, rank: np.ndarray, n: int):
    """Anchor, row, score: each anchor's first ``n`` rows for which ``same(anchor, row)``.

    ``wanted`` is how many there are of them at most.
    """
    scale = np.sqrt((q.astype(float) ** 2).sum(axis=1)) * index.norms[:, 0].max(initial=0.0)
    found = []
    for lo in range(0, len(q), SLICE_ANCHORS):
        open_ = np.arange(lo, min(lo + SLICE_ANCHORS, len(q)))
        open_ = open_[wanted[open_] > 0]
        for level in (*LEVELS, None):
            if not len(open_):
                break
            least = scale[open_] * level if level is not None else np.full(len(open_), _NOTHING_BELOW)
            a, r, score = index.join(q[open_], least)
            a = open_[a]
            keep = same(a, r)
            a, r, score = a[keep], r[keep], score[keep]
            full = np.bincount(a, minlength=len(q))[open_] >= np.minimum(wanted[open_], n)
            full |= level is None
            mine = np.isin(a, open_[full])
            best = _best(a[mine], score[mine], rank[r[mine]], n)
            found.append((a[mine][best], r[mine][best], score[mine][best]))
            open_ = open_[~full]
    return _joined(found)


def fill_windows(index: Index, q: np.ndarray, windows: list[list[tuple[int, int]]], other, rank, n: int):
    """Anchor, window, row, score: the first ``n`` rows with ``other(anchor, row)`` of each window."""
    found = []
    highest = np.array([min((w[1] for w in ws), default=0) for ws in windows], float)
    lowest = np.array([min((w[0] for w in ws), default=0) for ws in windows], float)
    counts = np.array([len(ws) for ws in windows])
    for lo in range(0, len(q), SLICE_ANCHORS):
        open_ = np.arange(lo, min(lo + SLICE_ANCHORS, len(q)))
        open_ = open_[counts[open_] > 0]
        for share in (0.1, 0.25, 0.5, 0.75, 1.0):
            if not len(open_):
                break
            least = highest[open_] - share * (highest[open_] - lowest[open_]) if share < 1 else lowest[open_]
            a, r, score = index.join(q[open_], least)
            a = open_[a]
            keep = other(a, r)
            a, r, score = a[keep], r[keep], score[keep]
            missing = np.zeros(len(q), np.int64)
            parts = []
            for j in range(int(counts[open_].max())):
                begin = np.array([ws[j][0] if j < len(ws) else 1 for ws in windows], np.int64)
                end = np.array([ws[j][1] if j < len(ws) else 0 for ws in windows], np.int64)
                inside = (score >= begin[a]) & (score <= end[a])
                wa, wr, ws_ = a[inside], r[inside], score[inside]
                short = np.bincount(wa, minlength=len(q)) < n
                # Full with n rows, or once everything down to the window's start was seen.
                floor = np.full(len(q), -np.inf)
                floor[open_] = least
                missing += (j < counts) & short & (floor > begin)
                best = _best(wa, ws_, rank[wr], n)
                parts.append((wa[best], np.full(len(best), j), wr[best], ws_[best]))
            full = missing[open_] == 0
            done = open_[full]
            for wa, wj, wr, ws_ in parts:
                mine = np.isin(wa, done)
                found.append((wa[mine], wj[mine], wr[mine], ws_[mine]))
            open_ = open_[~full]
    return _joined(found, 4)


def _joined(parts: list[tuple], width: int = 3) -> tuple:
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(width))
    return tuple(np.concatenate(c) for c in zip(*parts))


_BLOCK = "block long, ids binary, tags binary, labels binary, vectors binary"


def _blocks(rows: DataFrame, size: int, order: list[int], dtype: str) -> DataFrame:
    """Rows in blocks of about ``size``: their columns as bytes, dimensions in ``order``."""
    blocks = max(1, -(-rows.count() // size))

    def pack(table: pa.Table) -> pa.Table:
        x = table["x"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)[:, order]
        values = [table[c].to_numpy().astype(np.int64) for c in ("row", "place", "label")]
        return pa.table({
            "block": pa.array([table["block"][0].as_py()], pa.int64()),
            **{name: pa.array([v.tobytes()], pa.binary())
               for name, v in zip(("ids", "tags", "labels"), values)},
            "vectors": pa.array([np.ascontiguousarray(x.astype(dtype)).tobytes()], pa.binary()),
        })

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("long"))
    return dealt.groupBy("block").applyInArrow(pack, _BLOCK)


def _pairs(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Every block of anchors beside every block of rows, dealt evenly by both numbers."""
    counts = [df.agg(F.max("block")).first()[0] + 1 for df in (anchors, rows)]

    def spread(df: DataFrame, prefix: str, own: str, other: str, n: int) -> DataFrame:
        named = df.select(F.col("block").alias(own), *[
            F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != "block"
        ])
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        return named.withColumn(other, every).repartition(tasks, "anchors", "rows")

    tasks = min(counts[0] * counts[1], 100_000)
    left = spread(anchors, "a", "anchors", "rows", counts[1])
    right = spread(rows, "r", "rows", "anchors", counts[0])
    return left.join(right, ["anchors", "rows"])


def _unpacked(row: dict, prefix: str, width: int, dtype: str):
    ids, tags, labels = (np.frombuffer(row[f"{prefix}_{c}"], np.int64) for c in ("ids", "tags", "labels"))
    x = np.frombuffer(row[f"{prefix}_vectors"], dtype).reshape(-1, width)
    return ids, tags, labels, x


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One pair of blocks at a time."""
    for batch in batches:
        for k in range(len(batch)):
            yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


def _out(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(np.int64)) for c in columns], names)


def prepared(vectors: DataFrame, key: str, vector: str, label: Column, folder: str) -> DataFrame:
    """row, id, place, label, x: the rows that take part, in whole numbers, numbered.

    ``place`` orders rows of equal score: by key (NULL last), then by the vector's hash.
    """
    given = vectors.select(F.col(key).alias("id"), label.alias("label"), F.col(vector).alias("vec"))
    whole = F.transform("vec", lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    rows = given.filter(F.col("label").isNotNull() & usable(F.col("vec"))).select(
        "id", F.col("label").cast("long").alias("label"), whole.alias("x")
    )
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), folder, "rows")
    length = (
        rows.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.desc("length")).first()
    )
    rows = rows if length is None else rows.filter(F.size("x") == length["length"])
    return rows.withColumn("place", F.coalesce(F.col("id").cast("long"), F.lit(2**63 - 1)))


def mine(
    vectors: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding",
    label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW, folder: str | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` says of a row, with its key as ``id``, whether it is an anchor. A row
    without a label or with an unusable vector (NULL, empty, with NULL or non-finite or huge
    entries, of another length than most) takes no part. Equal scores go by the key, NULL
    last, then in the order in which the rows are stored; an anchor is no positive of its own, but
    another row under its key is. A positive that scores below 0 has an empty window. An
    empty table gives an empty result.
    """
    own, folder = folder is None, folder or run_folder(vectors.sparkSession, "negatives")
    rows = prepared(vectors, key, vector, F.col(label) if isinstance(label, str) else label, folder)
    kind = rows.schema["id"].dataType.simpleString()
    energy = (
        rows.select(F.posexplode("x").alias("place", "c")).groupBy("place")
        .agg(F.sum(F.col("c").cast("double") ** 2).alias("energy"), F.max(F.abs("c")).alias("most"))
        .orderBy(F.desc("energy"), "place").collect()
    )
    order, width = [r["place"] for r in energy], len(energy)
    most = max((int(r["most"]) for r in energy), default=0)
    largest = width * most * most
    if largest >= 2**62:
        raise ValueError("scores of these vectors do not fit 64 bits")
    # The cheapest type in which all sums are exact.
    dtype = "float32" if largest < 2**24 else "float64" if largest < 2**53 else "int64"
    chosen = rows.filter(F.coalesce(anchors, F.lit(False)))
    data = stored(_blocks(rows, BLOCK_ROWS, order, dtype), folder, "row-blocks")
    asked = stored(_blocks(chosen, BLOCK_ANCHORS, order, dtype), folder, "anchor-blocks")
    if not width or asked.isEmpty():
        return rows.sparkSession.createDataFrame(
            [], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, "
                "positive_score long, negative_score long"
        )

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in _each(batches):
            a_ids, _, a_labels, q = _unpacked(pair, "a", width, dtype)
            r_ids, places, labels, x = _unpacked(pair, "r", width, dtype)
            names, counts = np.unique(labels, return_counts=True)
            at = np.minimum(np.searchsorted(names, a_labels), len(names) - 1)
            there = np.where(names[at] == a_labels, counts[at], 0) - np.isin(a_ids, r_ids)
            a, r, score = nearest_alike(
                Index(x), q, there,
                lambda a, r: (labels[r] == a_labels[a]) & (r_ids[r] != a_ids[a]),
                _ranks(places, r_ids), positives,
            )
            yield _out([a_ids[a], r_ids[r], places[r], score], ["anchor", "row", "place", "score"])

    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "place", "row")
    best = stored(
        _pairs(asked, data).mapInArrow(alike, "anchor long, row long, place long, score long")
        .withColumn("r", F.row_number().over(first)).filter(F.col("r") <= positives).drop("r"),
        folder, "positives",
    )
    low, high = window
    limits = best.filter("score >= 0").groupBy("anchor").agg(
        F.sort_array(F.collect_set("score")).alias("scores")
    )
    wanted = stored(chosen.join(limits, chosen["row"] == limits["anchor"]).drop("anchor"), folder, "wanted")

    def with_limits(table: pa.Table) -> pa.Table:
        packed = [table[c].to_numpy().astype(np.int64) for c in ("row", "place", "label")]
        x = table["x"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)[:, order]
        scores = table["scores"].combine_chunks()
        return pa.table({
            "block": pa.array([table["block"][0].as_py()], pa.int64()),
            **{name: pa.array([v.tobytes()], pa.binary())
               for name, v in zip(("ids", "tags", "labels"), packed)},
            "vectors": pa.array([np.ascontiguousarray(x.astype(dtype)).tobytes()], pa.binary()),
            "scores": pa.array([scores.to_pylist()], pa.list_(pa.list_(pa.int64()))),
        })

    tasks = max(1, -(-wanted.count() // BLOCK_ANCHORS))
    asked = stored(
        wanted.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(tasks)).cast("long"))
        .groupBy("block").applyInArrow(with_limits, _BLOCK + ", scores array<array<bigint>>"),
        folder, "window-blocks",
    )

    def unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in _each(batches):
            a_ids, _, a_labels, q = _unpacked(pair, "a", width, dtype)
            r_ids, places, labels, x = _unpacked(pair, "r", width, dtype)
            windows = [
                [(max(-(-low * s // 100), -(2**62)), min(high * s // 100, 2**62)) for s in scores]
                for scores in pair["a_scores"]
            ]
            a, j, r, score = fill_windows(
                Index(x), q, windows, lambda a, r: labels[r] != a_labels[a], _ranks(places, r_ids), negatives,
            )
            of = np.array([pair["a_scores"][k][w] for k, w in zip(a, j)], np.int64)
            yield _out([a_ids[a], of, r_ids[r], places[r], score],
                       ["anchor", "positive_score", "row", "place", "score"])

    names = rows.select("row", "id")
    if asked.isEmpty():
        found = rows.sparkSession.createDataFrame([], "anchor long, positive_score long, row long, place long, score long")
    else:
        found = _pairs(asked, data).mapInArrow(
            unlike, "anchor long, positive_score long, row long, place long, score long"
        )
    per_window = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("score"), "place", "row")
    ranked = stored(
        found.withColumn("rank", F.row_number().over(per_window)).filter(F.col("rank") <= negatives),
        folder, "negatives",
    )

    if own:
        tidy(rows.sparkSession, folder, "rows", "positives", "negatives")

    def named(df: DataFrame, column: str, out: str) -> DataFrame:
        own = names.select(F.col("row").alias(column), F.col("id").alias(out))
        return df.join(own, column).drop(column)

    positive = named(
        best.select("anchor", F.col("row").alias("__positive"), F.col("score").alias("positive_score")),
        "__positive", "positive_id",
    )
    negative = named(
        ranked.select("anchor", "positive_score", "rank", F.col("row").alias("__negative"),
                      F.col("score").alias("negative_score")),
        "__negative", "negative_id",
    )
    return named(positive.join(negative, ["anchor", "positive_score"]), "anchor", "anchor_id").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _ranks(places: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The order among equal scores as one number."""
    out = np.empty(len(rows), np.int64)
    out[np.lexsort((rows, places))] = np.arange(len(rows))
    return out
