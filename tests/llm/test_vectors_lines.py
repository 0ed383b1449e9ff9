"""Whitening, hard negatives and line removal against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from helpers import corpus, frame

from callweave.llm import line_dedup, negatives, whitening
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int, id string, x long, row long, vec string, n int"


def vectors(spark, rows):
    """(vec_id, embedding, label) rows; the other columns clash with the operators' names."""
    return spark.createDataFrame([(*r, "i", 1, 2, "v", 3) for r in rows], VECTORS)


def sample(n=300, width=20, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, width)) * np.linspace(2, 0.3, width) + rng.normal(0, 1, width)
    x[: n // 3] = x[0] + rng.normal(0, 1e-3, (n // 3, width))
    rows = [(k, x[k].tolist(), int(rng.integers(0, 4))) for k in range(n)]
    odd = [
        (n, None, 1), (n + 1, [], 1), (n + 2, [1.0] * (width - 1) + [None], 1), (n + 3, [math.nan] * width, 2),
        (n + 4, [math.inf] + [0.0] * (width - 1), 2), (n + 5, [1.0], 2), (n + 6, [1e30] * width, 2),
        (None, x[5].tolist(), 2), (n + 7, x[6].tolist(), None), (7, x[7].tolist(), rows[7][2]),
    ]
    return rows + odd


def usable(rows, width=20):
    return [r for r in rows if r[1] and len(r[1]) == width
            and all(c is not None and abs(c) < 1e9 for c in r[1])]


# --- whitening


def whole(rows, scale, shift):
    return np.array([[math.floor(scale * float(np.float32(c))) + shift for c in r[1]] for r in rows])


def test_whitening_equals_plain_algebra(spark):
    rows = sample()
    got = whitening.whitening_report(vectors(spark, rows).repartition(7)).toPandas()
    used = usable(rows)
    x = whole(used, 1024, 100_000)
    n, sums = len(x), x.sum(axis=0)
    v = (x - sums / n).T @ (x - sums / n) / n
    values, directions = np.linalg.eigh(v)
    values, directions = values[::-1], directions[:, ::-1]
    assert len(got) == 8 * n and set(got["n"]) == {n}
    exact = Counter((r[0], int(d)) for r, d in zip(used, ((n * x - sums) ** 2).sum(axis=1)))
    found = got[got["component"] == 1]
    assert Counter((None if np.isnan(a) else int(a), int(b)) for a, b in zip(found["vec_id"], found["deviation"])) == exact
    for k in range(8):
        own = got[got["component"] == k + 1]
        assert np.allclose(own["explained"], values[k] / np.trace(v), rtol=1e-9)
        want = ((x - sums / n) @ directions[:, k] / np.sqrt(values[k]))
        by_id = own[own["vec_id"].notna()].groupby("vec_id")["whitened"].first()
        mine = np.array([by_id[r[0]] for r in used if r[0] is not None])
        want = np.array([w for w, r in zip(want, used) if r[0] is not None])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-7
    assert got["identity_error"].max() < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None, 0), (2, [], 1)]])
def test_whitening_of_nothing(spark, rows):
    got = whitening.whitening_report(vectors(spark, rows))
    assert got.collect() == []
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_without_variance(spark):
    rows = [(k, [float(k), 2.0, float(-k)], 0) for k in range(5)] + [(9, [1.0, 2.0, -1.0], 0)]
    got = whitening.whitening_report(vectors(spark, rows)).toPandas()
    assert len(got) == 18
    first, others = got[got["component"] == 1], got[got["component"] > 1]
    assert first["whitened"].notna().all() and np.allclose(first["explained"], 1)
    assert others["whitened"].isna().all() and (others["explained"] == 0).all()
    one = whitening.whitening_report(vectors(spark, rows[:1])).toPandas()
    assert one["whitened"].isna().all() and set(one["deviation"]) == {0}


@pytest.mark.parametrize("kind", ["random", "graded", "equal values", "low rank", "blocks"])
def test_solver(kind):
    rng = np.random.default_rng(3)
    if kind == "random":
        r = np.linalg.qr(rng.normal(size=(400, 30)), mode="r")
    elif kind == "graded":
        r = np.linalg.qr(rng.normal(size=(400, 30)) * np.logspace(0, -8, 30), mode="r")
    elif kind == "equal values":
        q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
        r = np.linalg.qr((q * np.r_[np.full(15, 3.0), np.ones(15)]) @ q.T, mode="r")
    elif kind == "low rank":
        r = np.concatenate([np.linalg.qr(rng.normal(size=(4, 30)), mode="r"), np.zeros((26, 30))])
    else:
        r = np.linalg.qr(np.kron(np.eye(2), rng.normal(size=(200, 15))), mode="r")
    diagonal, above, p = whitening.bidiagonal(r)
    values = whitening.squared_singular_values(diagonal, above)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    assert np.abs(values - want).max() < 1e-13 * want[0]
    if kind == "graded":
        assert np.abs(values / want - 1).max() < 1e-6
    y = p @ whitening.right_directions(diagonal, above, values, 8)
    assert np.abs(y.T @ y - np.eye(8)).max() < 1e-11
    assert np.abs(r.T @ (r @ y) - y * values[:8]).max() < 1e-12 * want[0]


def test_triangles_are_merged_in_steps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "MERGE_BYTES", 1)
    rows = whitening.fit_list(vectors(spark, sample()).repartition(9), "vec_id", "embedding", str(tmp_path))
    n, sums = whitening._sums(rows)
    r = whitening.triangle(rows.repartition(9), n, sums, str(tmp_path))
    x = np.array([q["x"] for q in rows.collect()], float) - np.array(sums) / n
    assert np.abs(r.T @ r - x.T @ x).max() < 1e-9 * np.abs(x.T @ x).max()


# --- hard negatives


def mined(rows, every, window=(30, 90)):
    rows = [r for r in usable(rows) if r[2] is not None]
    x = whole(rows, 256, 0)
    ids = [2**63 if r[0] is None else r[0] for r in rows]
    out = Counter()
    for a, r in enumerate(rows):
        if r[0] is None or r[0] % every:
            continue
        score = [int(s) for s in x @ x[a]]
        order = sorted(range(len(rows)), key=lambda k: (-score[k], ids[k]))
        for p in [k for k in order if k != a and rows[k][2] == r[2]][:5]:
            hard = [k for k in order if rows[k][2] != r[2]
                    and window[0] * score[p] <= 100 * score[k] <= window[1] * score[p]][:10]
            for rank, k in enumerate(hard, 1):
                out[r[0], rows[p][0], rank, rows[k][0], int(score[p]), int(score[k])] += 1
    return out


NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("blocks", [(4096, 2048, 256), (64, 16, 5)])
def test_negatives_equal_brute_force(spark, monkeypatch, blocks):
    for name, value in zip(("BLOCK_ROWS", "BLOCK_ANCHORS", "SLICE_ANCHORS"), blocks):
        monkeypatch.setattr(negatives, name, value)
    rows = [r for r in sample() if r[0] != 7]
    got = negatives.mine(vectors(spark, rows).repartition(5), F.col("id") % 10 == 0)
    assert Counter(tuple(r) for r in got.select(*NAMES).collect()) == mined(rows, 10)


def test_negatives_with_large_entries_and_few_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=20) * 10.0**5).tolist(), k % 2) for k in range(12)]
    got = negatives.mine(vectors(spark, rows), F.col("id") % 3 == 0, window=(-10**6, 90))
    assert Counter(tuple(r) for r in got.select(*NAMES).collect()) == mined(rows, 3, (-10**6, 90))


def test_negatives_pair_with_another_row_of_the_same_key(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (5, [0.5, 0.0], 2), (6, [0.5, 0.0], 2)]
    got = negatives.mine(vectors(spark, rows), F.col("id") == 0).collect()
    assert Counter(tuple(r[n] for n in NAMES) for r in got) == Counter(
        {(0, 0, 1, 5, 65536, 32768): 2, (0, 0, 2, 6, 65536, 32768): 2}
    )


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 0)], [(0, None, 0)], [(0, [1.0, 2.0], 0)]])
def test_negatives_of_nothing(spark, rows):
    got = negatives.mine(vectors(spark, rows), F.col("id") % 10 == 0)
    assert got.collect() == [] and set(got.columns) == set(NAMES)


def test_suffixes_are_left_out_of_the_index():
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(500, 64)) * np.linspace(300, 1, 64)).round().astype("float32")
    index, q = negatives.Index(x), x[:20]
    scale = np.sqrt((q.astype(float) ** 2).sum(axis=1)) * index.norms[:, 0].max()
    for level in (0.5, 0.1, -0.2):
        a, r, score = index.join(q, level * scale)
        want = {(i, j) for i, j in zip(*np.nonzero(q @ x.T >= (level * scale)[:, None]))}
        assert set(zip(a.tolist(), r.tolist())) == want and len(a) == len(want)
        assert (score == (q @ x.T)[a, r]).all()


# --- lines


def key_of(line):
    bare = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in bare)


def cleaned(rows, least, chars=1):
    lines = [(r[1] or "").split("\n") for r in rows]
    seen = Counter(k for own in lines for k in {key_of(l) for l in own})
    out = Counter()
    for r, own in zip(rows, lines):
        stay = [l for l in own if len(key_of(l)) < chars or seen[key_of(l)] < least]
        digest = hashlib.sha256("\n".join(stay).encode()).hexdigest()
        out[r[0], len(own), len(own) - len(stay), digest] += 1
    return out


def line_rows():
    rng = random.Random(8)
    common = ["Read more", "  read MORE\t", "é", "É", "\x0b", "", "©\x85 2020", "x" * 300]
    rows = [
        (k, "\n".join(rng.choice(common + [f"line {rng.randrange(60)}", f"own {k}"])
                      for _ in range(rng.randrange(12))), "en", "s0")
        for k in range(120)
    ]
    return rows + corpus() + [(None, "read more\n", None, None), (3, None, None, None)]


@pytest.mark.parametrize("most", [line_dedup.MAX_INDEX_BYTES, 1])
def test_lines_equal_brute_force(spark, monkeypatch, most):
    rows = line_rows()
    build = line_dedup.build_index
    monkeypatch.setattr(line_dedup, "build_index", lambda *a: build(*a, shard_keys=16))
    got = line_dedup.line_report(frame(spark, rows).repartition(3), min_documents=3, max_index_bytes=most)
    names = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert Counter(tuple(r) for r in got.select(*names).collect()) == cleaned(rows, 3)


def test_short_keys_stay(spark):
    rows = line_rows()
    got = line_dedup.line_report(frame(spark, rows), min_documents=2, min_chars=5)
    names = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert Counter(tuple(r) for r in got.select(*names).collect()) == cleaned(rows, 2, 5)


def test_no_lines(spark):
    assert line_dedup.line_report(frame(spark, [])).collect() == []
    kept = line_dedup.drop_frequent_lines(frame(spark, [(1, None, "en", "s")] * 12)).collect()
    assert {(r["n_lines"], r["n_dropped"], r["text"]) for r in kept} == {(1, 0, "")}


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    sizes, bits = line_dedup.build_levels(keys)
    numbers = line_dedup.numbers_of(keys, sizes, bits, np.cumsum(bits) - 1)
    assert sorted(numbers.tolist()) == list(range(len(keys)))
    assert len(bits) < 6 * len(keys)
