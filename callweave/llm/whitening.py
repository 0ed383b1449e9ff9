"""Whitening of embeddings by a bidiagonal qd solver.

Centred rows are reduced block by block: each Arrow batch is stacked on its partition's
triangle and factored by QR, and the triangles of the partitions are merged a bounded number
at a time until one is left. That triangle R, as wide as a vector, holds the covariance
(R'R = n V) without ever having multiplied the rows. Householder reflections make it
bidiagonal, dqds finds the singular values to high relative accuracy, and twisted
factorisations give the directions.

Only sums, one triangle and the few directions reach the driver: their size depends on
the length of a vector, not on the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from callweave.llm.common import run_folder, stored, tidy

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: Entries from here on have no exact integer form and count as not finite.
LARGEST = float(2**39)
#: Bytes of triangles that one task merges.
MERGE_BYTES = 32 << 20
#: Eigenvalues nearer to each other than this, relatively, are one cluster.
CLUSTER = 1e-3
_EPS = np.finfo(float).eps


@dataclass(frozen=True)
class Whitening:
    """``directions`` are columns of unit length, ``values`` their eigenvalues, falling."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    trace: float


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and P with ``r = U B P'``, by Householder reflections."""
    a = np.array(r, float)
    n = len(a)
    p = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.abs(x).max() if len(x) else 0.0
        if size == 0.0:
            return None
        v = x / size
        v[0] += math.copysign(float(np.sqrt(v @ v)), v[0])
        return v / np.sqrt(v @ v)

    for k in range(n):
        v = reflector(a[k:, k].copy())
        if v is not None:
            a[k:, k:] -= 2.0 * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v = reflector(a[k, k + 1 :].copy())
            if v is not None:
                a[k:, k + 1 :] -= 2.0 * np.outer(a[k:, k + 1 :] @ v, v)
                p[:, k + 1 :] -= 2.0 * np.outer(p[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One transform with a shift; ``None`` where the shift is above the least value."""
    new_q, new_e, d = [], [], q[0] - shift
    for k in range(len(e)):
        if d < 0.0:
            return None
        total = d + e[k]
        ratio = q[k + 1] / total if total > 0.0 else 0.0
        new_q.append(total)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift if total > 0.0 else q[k + 1] - shift
    if d < 0.0:
        return None
    new_q.append(d)
    return new_q, new_e


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix by dqds, falling.

    A shift that proves too large is cut to a quarter and tried again from the same arrays,
    at last without a shift, which always succeeds; so no digits are lost.
    """
    found: list[float] = []
    work = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0)]
    while work:
        q, e, moved = work.pop()
        turns = 0
        while len(q) > 1:
            n = len(q)
            # Negligible couplings split the matrix; the last one gives a value.
            cut = next(
                (k for k in range(n - 2, -1, -1)
                 if e[k] <= (100 * _EPS) ** 2 * (moved + q[k + 1]) or e[k] <= 1e-300), None,
            )
            if cut is not None:
                if cut < n - 2:
                    work.append((q[: cut + 1], e[:cut], moved))
                    q, e = q[cut + 1 :], e[cut + 1 :]
                else:
                    found.append(moved + q[-1])
                    q, e = q[:-1], e[:-1]
                turns = 0
                continue
            turns += 1
            # The lesser root of the last two rows is near the least value from above.
            mean = (q[-2] + e[-1] + q[-1]) / 2
            root = q[-2] * q[-1] / (mean + math.sqrt(max(mean * mean - q[-2] * q[-1], 0.0))) if mean > 0 else 0.0
            shift = min(root, min(q)) * (1 - 4 * _EPS) if turns > 1 else 0.0
            after = None
            for _ in range(8):
                after = _dqds(q, e, shift)
                if after is not None or shift == 0.0:
                    break
                shift /= 4
            if after is None:
                shift = 0.0
                after = _dqds(q, e, 0.0)
            q, e = after
            moved += shift
            if turns == 1 and q[0] < q[-1]:  # graded the wrong way round: same values flipped
                q, e = q[::-1], e[::-1]
        if q:
            found.append(moved + q[0])
    return np.array(sorted(found, reverse=True))


def twisted_vectors(
    diagonal: np.ndarray, above: np.ndarray, value: float
) -> Iterator[tuple[float, np.ndarray]]:
    """(|gamma|, unit vector) for every twist of ``B'B - value``, the best twist first.

    The stationary transform factors from the top, the progressive one from the bottom;
    at the twist both meet, and the least ``gamma`` marks where the eigenvector is large.
    """
    n = len(diagonal)
    tiny = np.finfo(float).tiny
    d2, b2, ab = diagonal**2, above**2, diagonal[:-1] * above
    s, low = np.zeros(n), np.zeros(n - 1)
    s[0] = -value
    for k in range(n - 1):
        pivot = s[k] + d2[k]
        pivot = pivot if abs(pivot) > tiny else tiny
        low[k] = ab[k] / pivot
        s[k + 1] = b2[k] * s[k] / pivot - value
    p, up = np.zeros(n), np.zeros(n - 1)
    p[-1] = d2[-1] - value
    for k in range(n - 2, -1, -1):
        pivot = b2[k] + p[k + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        up[k] = ab[k] / pivot
        p[k] = d2[k] * p[k + 1] / pivot - value
    gamma = np.abs(s + p + value)
    gamma[~np.isfinite(gamma)] = np.inf
    for twist in np.argsort(gamma, kind="stable"):
        z = np.zeros(n)
        z[twist] = 1.0
        for k in range(twist - 1, -1, -1):
            z[k] = -low[k] * z[k + 1]
        for k in range(twist, n - 1):
            z[k + 1] = -up[k] * z[k]
        if np.isfinite(z).all():
            yield float(gamma[twist]), z / np.sqrt(z @ z)


def right_directions(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` eigenvectors of ``B'B``, columns of unit length.

    Inside a cluster of near values one twist cannot tell the vectors apart: other
    twists are tried, each without what earlier vectors of the cluster cover, until one
    has enough left and solves the equation.
    """
    n = len(diagonal)
    out = np.zeros((n, count))

    def times(z: np.ndarray) -> np.ndarray:
        y = diagonal * z
        y[:-1] += above * z[1:]
        x = diagonal * y
        x[1:] += above * y[:-1]
        return x

    for k in range(count):
        first = k
        while first and values[first - 1] - values[k] <= CLUSTER * values[k]:
            first -= 1
        before = out[:, first:k]
        best, best_error = None, np.inf
        for tried, (_, z) in enumerate(twisted_vectors(diagonal, above, float(values[k]))):
            for _ in range(2):
                z = z - before @ (before.T @ z)
            size = np.sqrt(z @ z)
            if size > 1e-3:
                z = z / size
                z = z - before @ (before.T @ z)
                z = z / np.sqrt(z @ z)
                error = np.abs(times(z) - values[k] * z).max()
                if error < best_error:
                    best, best_error = z, error
                if error <= 64 * n * _EPS * values[0]:
                    break
            if first == k and tried >= 2:
                break
        if best is None:  # nothing left of any twist: any direction outside the cluster's
            q, _ = np.linalg.qr(np.column_stack([out[:, :k], np.eye(n)]))
            best = q[:, k]
        out[:, k] = best
    return out


def usable(vector: Column) -> Column:
    """Whether a vector has entries and all of them are finite numbers below :data:`LARGEST`."""
    return F.coalesce(
        (F.size(vector) > 0)
        & F.forall(vector, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False))),
        F.lit(False),
    )


def fit_list(vectors: DataFrame, key: str, vector: str, folder: str) -> DataFrame:
    """id, x: the vectors that take part, in whole numbers.

    Vectors of another length than the most frequent one (the longer of two) take no part.
    """
    given = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vec")).filter(usable(F.col("vec")))
    whole = F.transform("vec", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    rows = stored(given.select("id", whole.alias("x")), folder, "rows")
    length = (
        rows.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.desc("length")).first()
    )
    return rows if length is None else rows.filter(F.size("x") == length["length"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S`` exactly: 64-bit numbers where they suffice, else Python's."""
    if n * int(np.abs(x).max(initial=0)) < 2**61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column("x"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(x)] * x.shape[1]), pa.array(range(x.shape[1])), pa.array(x.sum(axis=0))],
                    ["n", "place", "total"],
                )

    parts = rows.select("x").mapInArrow(add, "n long, place long, total long")
    totals = parts.groupBy("place").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    ).orderBy("place").collect()
    return (totals[0]["n"] if totals else 0), [int(r["total"]) for r in totals]


def _triangle(blocks: list[np.ndarray], width: int) -> np.ndarray:
    r = np.linalg.qr(np.concatenate(blocks), mode="r")
    return np.concatenate([r, np.zeros((width - len(r), width))]) if len(r) < width else r


def triangle(rows: DataFrame, n: int, sums: list[int], folder: str) -> np.ndarray:
    """R of the centred rows: a triangle per partition, then merged in steps.

    A step merges :data:`MERGE_BYTES` of triangles per task, at least two, so no task
    ever sees more; every step is a written table.
    """
    width = len(sums)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, width))
        for batch in batches:
            if len(batch):
                centred = (_deviations(_matrix(batch.column("x")), n, sums) / n).astype(float)
                held = _triangle([held, centred], width)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["r"])

    def merge(table: pa.Table) -> pa.Table:
        # A fixed order: the same triangles give the same result.
        found = sorted(table["r"].to_pylist())
        blocks = [np.frombuffer(b).reshape(width, width) for b in found]
        return pa.table({"r": pa.array([_triangle(blocks, width).tobytes()], pa.binary())})

    fan = max(2, MERGE_BYTES // (8 * width * width))
    parts = stored(rows.select("x").mapInArrow(reduce_rows, "r binary"), folder, "triangles-0")
    step = 0
    while (count := parts.count()) > 1:
        step += 1
        groups = -(-count // fan)
        dealt = parts.withColumn("g", F.pmod(F.xxhash64("r"), F.lit(groups)))
        parts = stored(dealt.groupBy("g").applyInArrow(merge, "r binary"), folder, f"triangles-{step}")
    return np.frombuffer(parts.first()["r"]).reshape(width, width)


def fit(rows: DataFrame, folder: str, components: int = COMPONENTS) -> Whitening | None:
    """Sums, directions and eigenvalues; ``None`` for an empty list."""
    n, sums = _sums(rows)
    if not n:
        return None
    r = triangle(rows, n, sums, folder)
    diagonal, above, p = bidiagonal(r)
    values = squared_singular_values(diagonal, above)
    count = min(components, len(values))
    z = right_directions(diagonal, above, values, count)
    # Values of rounding size only are 0: the rows do not vary in such a direction.
    floor = values[0] * (len(values) * _EPS) ** 2 * 4 if len(values) else 0.0
    kept = np.where(values[:count] > floor, values[:count], 0.0)
    return Whitening(n, sums, p @ z, kept / n, float((r * r).sum()) / n)


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """id, deviation, whitened (one entry per component) per row of the fit list.

    A deviation that does not fit 64 bits is NULL, and so is a component without variance.
    """
    deviations = np.sqrt(model.values)
    per = np.divide(1.0, deviations, out=np.full(len(deviations), np.nan), where=deviations > 0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = _deviations(_matrix(batch.column("x")), model.n, model.sums)
            if moved.dtype != object and moved.shape[1] * float(np.abs(moved).max(initial=0)) ** 2 >= 2**62:
                moved = moved.astype(object)
            total = [int(t) if t < 2**63 else None for t in (moved * moved).sum(axis=1)]
            w = (moved / model.n).astype(float) @ model.directions * per
            flat = pa.array(w.ravel(), from_pandas=True)
            ends = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(total, pa.int64()), pa.ListArray.from_arrays(ends, flat)],
                ["id", "deviation", "whitened"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "x").mapInArrow(
        project, f"id {kind}, deviation long, whitened array<double>"
    )


def identity_error(whitened: DataFrame, components: list[int]) -> float | None:
    """Largest absolute entry of the covariance minus the identity, over these components."""
    pairs = [(a, b) for a in components for b in components if a <= b]
    if not pairs:
        return None
    at = lambda k: F.get("whitened", F.lit(k))
    row = whitened.agg(*[F.covar_pop(at(a), at(b)).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(row[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whitening_report(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
    components: int = COMPONENTS, folder: str | None = None,
) -> DataFrame:
    """One row per remaining vector and component: the key, component, n, deviation, whitened,
    explained, identity_error.

    Vectors that are NULL or empty or hold NULL, non-finite or huge entries are left
    out, as are those of another length than the most frequent one; repeated rows and
    NULL keys are rows like any others. A component in which the rows do not vary has
    NULL for whitened and 0 for explained. An empty list gives an empty result; other
    columns are not read.
    """
    own, folder = folder is None, folder or run_folder(vectors.sparkSession, "whitening")
    rows = fit_list(vectors, key, vector, folder)
    model = fit(rows, folder, components)
    if model is None:
        model = Whitening(1, [], np.zeros((0, 0)), np.zeros(0), 0.0)
        rows = rows.limit(0)
    scores = stored(whiten(rows, model), folder, "whitened")
    if own:
        tidy(vectors.sparkSession, folder, "whitened")
    error = identity_error(scores, [k for k, v in enumerate(model.values) if v > 0])
    explained = F.array(*[F.lit(float(v / model.trace) if model.trace else 0.0) for v in model.values])
    return scores.select("id", "deviation", F.posexplode("whitened").alias("__place", "value")).select(
        F.col("id").alias(key), (F.col("__place") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"),
        F.get(explained, F.col("__place")).cast("double").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
