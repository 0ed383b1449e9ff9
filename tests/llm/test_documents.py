"""Operators over documents against brute force, on tables with every odd case."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from helpers import corpus, family, frame, words

from callweave.llm import (
    exact_dedup, hashing, language, line_quality, mixing, near_dedup, repeats, toxicity,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def as_tuples(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


# --- exact copies


def exact_expected(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        kept = False
        for i in ids:
            own = i == keep and not kept
            kept |= own
            out.append((i, keep, len(ids), own, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_report(docs, rows):
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert as_tuples(exact_dedup.group_report(docs), *names) == exact_expected(rows)


def test_exact_saturated_filter(spark, docs, rows, tmp_path):
    folder = str(tmp_path)
    keyed = docs.selectExpr("xxhash64(coalesce(text, '')) as k", "coalesce(text, '') as t")
    marked = exact_dedup.mark_possible_repeats(keyed, "k", "maybe", folder, max_filter_bytes=1)
    texts = collections.Counter(r[1] or "" for r in rows)
    got = {r["t"]: r["maybe"] for r in marked.collect()}
    assert all(got[t] for t, n in texts.items() if n > 1)


def test_exact_keep_one(docs, rows):
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert len(found) == len({r[1] or "" for r in rows})
    best = {}
    for r in rows:
        key = r[1] or ""
        best[key] = max(best.get(key, -1), -1 if r[0] is None else r[0])
    assert all((-1 if r["doc_id"] is None else r["doc_id"]) == best[r["text"] or ""] for r in found)


# --- quality rules


def test_quality_counts(docs, rows):
    got = collections.Counter(
        as_tuples(line_quality.quality_report(docs, max_documents=3),
                  "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                  "n_repeat_words", "words_removed", "base_failed", "kept")
    )
    squeeze = lambda l: re.sub(r"[\x20\x09-\x0D]+", " ", l.lower()).strip(" ")
    seen = collections.defaultdict(set)
    for _, text, _, source in rows:
        for l in (text or "").split("\n"):
            if WORD.search(l):
                seen[source, squeeze(l)].add(text)
    want = collections.Counter()
    for doc_id, text, _, source in rows:
        text = text or ""
        w = WORD.findall(text)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
        lines = [l for l in text.split("\n") if WORD.search(l)]
        removed = sum(len(WORD.findall(l)) for l in lines if len(seen[source, squeeze(l)]) > 3)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        kept = not failed and len(w) - removed >= 50 and removed <= 0.5 * len(w)
        want[doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
             len(lines) - len(set(lines)), len(covered), removed, failed, kept] += 1
    assert got == want


# --- mixing


def targets_brute(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, target = share * sum(sizes.values()), dict.fromkeys(names, 0.0)
    free = list(names)
    while free and left > 1e-9:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if most * sizes[s] - target[s] <= unit * weight[s]]
        if not over:
            for s in free:
                target[s] += unit * weight[s]
            break
        for s in over:
            left -= most * sizes[s]
            target[s] = most * sizes[s]
            free.remove(s)
    return target


def test_mix_report(docs, rows):
    got = mixing.mix_report(docs).toPandas()
    sizes = collections.Counter()
    for _, text, _, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    target = targets_brute(sizes)
    assert len(got) == len(rows)
    for r in got.itertuples():
        source = None if pd.isna(r.source) else r.source
        assert r.source_size == sizes[source]
        assert math.isclose(r.target, target[source], rel_tol=1e-9, abs_tol=1e-6)
        assert r.taken in (0, r.size, 2 * r.size)
    for source, own in got.groupby(got.source.fillna("none")):
        # The budget is met to within half of the document that it ends in (or its equals).
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 2 * own["size"].max()


def test_mix_takes_by_keys(docs):
    """Within a source no document left out has a smaller key than one selected."""
    frame_ = docs.sparkSession.createDataFrame(
        [(k, " ".join(["w"] * (k % 7 + 1)), None, "s") for k in range(500)],
        "doc_id long, text string, lang string, source string",
    )
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_report(frame_, share=0.5).collect()}
    keys = {r["doc_id"]: (r["__key"], r["__size"]) for r in mixing.with_keys(frame_).collect()}
    inside = [keys[k][0] for k in keys if taken[k]]
    outside = [keys[k][0] for k in keys if not taken[k]]
    assert max(inside) <= min(outside)
    total = sum(s for _, s in keys.values())
    assert abs(sum(taken.values()) - total / 2) <= 7


def test_mix_repeats_documents(docs, rows):
    report, least = collections.Counter(), {}
    for r in mixing.mix_report(docs).collect():
        if r["taken"]:
            report[r["doc_id"]] += r["taken"] // r["size"]
        elif not r["size"]:
            least[r["doc_id"], r["source"]] = int(r["target"] // r["source_size"]) if r["source_size"] else 1
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    found = mixed.collect()
    worded = [r for r in found if WORD.search(r["text"] or "")]
    assert collections.Counter(r["doc_id"] for r in worded) == report
    # Documents without words are in every epoch too.
    given = collections.Counter((r[0], r[3], r[1]) for r in rows if not WORD.search(r[1] or ""))
    have = collections.Counter((r["doc_id"], r["source"], r["text"]) for r in found if not WORD.search(r["text"] or ""))
    for (doc_id, source, text), n in given.items():
        epochs = least[doc_id, source]
        assert epochs * n <= have[doc_id, source, text] <= (epochs + 1) * n
    assert set(have) <= set(given) and any(have.values())


def symbol_rich(n=4000):
    """Short texts full of symbols: their keys are large, and most are near each other."""
    rng = random.Random(6)
    return [(k, "#*$ " * 3 + f"w{rng.randrange(9)}", "en", "s0") for k in range(n)] + [
        (n + k, words(rng, 60), "en", "s0") for k in range(300)
    ] + [(9999, "the same row again " * 4, "en", "s1")] * 900


def test_mix_sorts_few_rows(spark, tmp_path, monkeypatch):
    docs = frame(spark, symbol_rich())
    whole = as_tuples(mixing.mix_report(docs), "doc_id", "size", "source_size", "target", "taken")
    monkeypatch.setattr(mixing, "SORTED_ROWS", 40)
    monkeypatch.setattr(mixing, "KEY_SLOTS", 3)
    folder = str(tmp_path)
    assert as_tuples(mixing.mix_report(docs, folder=folder), "doc_id", "size", "source_size", "target", "taken") == whole
    cuts = sorted(tmp_path.glob("cut-*"), key=lambda f: int(f.name[4:]))
    assert len(cuts) > 2
    last = spark.read.parquet(str(cuts[-1])).collect()
    assert all(r["rows"] <= 40 or r["low"] == r["high"] for r in last)
    taken = collections.defaultdict(int)
    for doc_id, size, _, target, t in whole:
        taken[target] += t
    for target, t in taken.items():
        assert abs(t - target) <= 0.02 * target + 900 * 16


# --- near copies


def shingle_counts(text):
    w = WORD.findall(text or "")
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}


def probability_jaccard(x, y):
    total = 0.0
    for d in x.keys() & y.keys():
        total += 1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys())
    return total


def test_near_classes(docs, rows):
    got = near_dedup.class_report(docs).collect()
    assert len(got) == len(rows)
    texts = sorted({r[1] or "" for r in rows})
    sets = [shingle_counts(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if not sets[a] or not sets[b] or not sets[a].keys() & sets[b].keys():
                continue
            plain = len(sets[a].keys() & sets[b].keys()) / len(sets[a].keys() | sets[b].keys())
            if max(plain, probability_jaccard(sets[a], sets[b])) >= 0.8:
                root[find(a)] = find(b)
    place = {t: k for k, t in enumerate(texts)}
    members = collections.defaultdict(list)
    for r in rows:
        members[find(place[r[1] or ""])].append(r[0])
    want = []
    for ids in members.values():
        known = [i for i in ids if i is not None]
        want += [(i, min(known) if known else None, len(ids)) for i in ids]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_near_keep_one(docs):
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    classes = near_dedup.class_report(docs)
    n = classes.filter("class_id is not null").select("class_id").distinct().count()
    known = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert len(known) == len(set(known)) or len(known) >= n
    assert kept.count() <= docs.count()


def test_copies_alike_only_through_their_base(spark):
    rows = family(300)
    got = near_dedup.class_report(frame(spark, rows)).collect()
    assert {(r["class_id"], r["class_size"]) for r in got} == {(0, len(rows))}


def template(share, n=300, n_words=240, seed=3):
    """Texts that share a template and are no near copies, and a near copy of each."""
    rng = random.Random(seed)
    base, keep = [f"t{k}" for k in range(n_words)], int(n_words * share)
    rows = []
    for k in range(n):
        text = base[:keep] + [f"d{k}w{i}" for i in range(n_words - keep)]
        while True:
            copy = list(text)
            for _ in range(rng.choice((4, 5))):
                copy[rng.randrange(n_words)] = f"e{rng.random()}"
            x, y = shingle_counts(" ".join(text)).keys(), shingle_counts(" ".join(copy)).keys()
            if 0.8 <= len(x & y) / len(x | y) <= 0.85:
                break
        rows += [(2 * k, " ".join(text), "en", "s0"), (2 * k + 1, " ".join(copy), "en", "s0")]
    return rows


@pytest.mark.parametrize("share", [0.67, 0.8, 0.857])
def test_near_copies_inside_a_template_family(spark, share):
    """Similarities of 0.5, 0.66 and 0.75 between the texts of the family."""
    rows = template(share)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.class_report(frame(spark, rows)).collect()}
    found = [got[2 * k] == got[2 * k + 1] for k in range(len(rows) // 2)]
    assert np.mean(found) >= 0.97
    assert len({got[2 * k] for k in range(len(rows) // 2)}) == len(rows) // 2


def test_few_pairs_of_a_template_family_are_verified(spark, tmp_path):
    rows = [(k, " ".join([f"t{i}" for i in range(300)] + [f"d{k}w{i}" for i in range(100)]), "en", "s0")
            for k in range(800)]
    near_dedup.class_report(frame(spark, rows), folder=str(tmp_path)).count()
    n = sum(
        spark.read.parquet(str(f)).count() for f in tmp_path.iterdir() if f.name in ("round-0", "round-1", "rest")
    )
    assert n < 0.03 * 800 * 799 / 2


def test_buckets_are_split_and_compared_in_full_at_the_end(spark, monkeypatch):
    """All limits tiny: the last level has to compare many members outside the largest class."""
    for name, value in {"FEW": 2, "PIECE": 4, "LEVELS": 1, "LEADERS": (1,), "LOT": 3}.items():
        monkeypatch.setattr(near_dedup, name, value)
    rows = template(0.857, n=40)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.class_report(frame(spark, rows)).collect()}
    assert all(got[2 * k] == got[2 * k + 1] for k in range(40)) and len(set(got.values())) == 40


def test_repeated_lines_do_not_hide_a_near_copy(spark):
    rows = []
    for k in range(20):
        body = " ".join(f"d{k}w{i}" for i in range(200))
        line = "\n" + " ".join(f"d{k}r{i}" for i in range(10))
        rows += [(2 * k, body + line * 2, "en", "s0"), (2 * k + 1, body + line * 100, "en", "s0")]
    got = near_dedup.class_report(frame(spark, rows)).collect()
    assert {(r["doc_id"] // 2 * 2, r["class_size"]) for r in got} == {(2 * k, 2) for k in range(20)}
    assert all(r["class_id"] == r["doc_id"] // 2 * 2 for r in got)


def test_probability_jaccard_of_arrays():
    rng = np.random.default_rng(5)
    for _ in range(40):
        x = {int(k): int(v) for k, v in zip(rng.integers(0, 30, 12), rng.integers(1, 5, 12))}
        y = {int(k): int(v) for k, v in zip(rng.integers(0, 30, 12), rng.integers(1, 5, 12))}
        pair = [(np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)])) for d in (x, y)]
        plain = len(x.keys() & y.keys()) / len(x.keys() | y.keys())
        assert math.isclose(near_dedup.similarity(*pair), max(plain, probability_jaccard(x, y)), abs_tol=1e-12)


def test_registers_estimate_the_similarity():
    rng = np.random.default_rng(6)
    common, registers = rng.integers(1, 1 << 62, 300, dtype=np.uint64), 4096
    x = np.concatenate([common, rng.integers(1, 1 << 62, 100, dtype=np.uint64)])
    y = np.concatenate([common, rng.integers(1, 1 << 62, 50, dtype=np.uint64)])
    wx, wy = rng.integers(1, 4, len(x)), rng.integers(1, 4, len(y))
    rows = np.repeat([0, 1], [len(x), len(y)])
    found = near_dedup.signatures(rows, np.concatenate([x, y]), np.concatenate([wx, wy]), 2, registers)
    exact = probability_jaccard(dict(zip(x.tolist(), wx.tolist())), dict(zip(y.tolist(), wy.tolist())))
    assert abs((found[0] == found[1]).mean() - exact) < 0.04


# --- repeated strings


def repeats_expected(rows, length=repeats.LENGTH):
    docs = {}
    for doc_id, text, *_ in rows:
        text = (text or "")
        tag = repeats_tag(text)
        docs[(doc_id is None, doc_id or 0, tag, text)] = text.encode()
    seen, out, emptied = set(), {}, {}
    for key in sorted(docs):
        data = docs[key]
        if key[3] in emptied:
            out[key] = emptied[key[3]]
            continue
        covered = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            part = data[k : k + length]
            if part in seen:
                covered[k : k + length] = True
            seen.add(part)
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~covered])
        out[key] = (len(data), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest())
        n = len(data)
        emptied[key[3]] = (n, n, 1, hashlib.sha256(b"").hexdigest()) if n >= length else out[key]
    return sorted(
        ((r[0], *out[(r[0] is None, r[0] or 0, repeats_tag(r[1] or ""), r[1] or "")]) for r in rows), key=str
    )


def repeats_tag(text):
    return TAGS[text]


TAGS = {}


def test_repeats(docs, rows):
    for r in docs.selectExpr("coalesce(text, '') as t", "shiftrightunsigned(xxhash64(coalesce(text, '')), 2) as h").collect():
        TAGS[r["t"]] = r["h"]
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert as_tuples(repeats.repeat_report(docs), *names) == repeats_expected(rows)


def test_repeats_of_rows_that_share_an_id(spark):
    rng = random.Random(21)
    shared = ["".join(rng.choices("abcdefgh ", k=140)) for _ in range(40)]
    own = lambda: "".join(rng.choices("abcdefgh ", k=rng.randrange(20, 90)))
    rows = []
    for k in range(5000):
        doc_id = None if k < 2500 else 7 if k < 4900 else 2**63 - 1
        rows.append((doc_id, f"{k} " + own() + rng.choice(shared) * (k % 5 == 0) + own(), "en", "s0"))
    test_repeats(frame(spark, rows).repartition(4), rows)


def test_maximal_repeats_are_all_found():
    import random

    rng = random.Random(4)
    before = [bytes(rng.choice(b"ab") for _ in range(80)) for _ in range(12)]
    after = [bytes(rng.choice(b"ab") for _ in range(80)) for _ in range(12)]
    for k in range(1, 12, 2):
        before[k] = before[k - 1][:50] + before[k][50:]
        after[k] = after[k - 1][:40] + after[k][40:]
    found = {(l, r, tuple(sorted(m))) for l, r, m in repeats.maximal_repeats(before, after)}
    want = set()
    for l in range(81):
        for r in range(max(0, repeats.REACH - l), 81):
            groups = collections.defaultdict(list)
            for k in range(12):
                groups[before[k][:l], after[k][:r]].append(k)
            for m in groups.values():
                wider = len(m) > 1 and (
                    l < 80 and len({before[k][: l + 1] for k in m}) == 1
                    or r < 80 and len({after[k][: r + 1] for k in m}) == 1
                )
                if len(m) > 1 and not wider:
                    want.add((l, r, tuple(m)))
    assert found == want


# --- learned scores


def test_toxicity(spark):
    import random

    rng = random.Random(9)
    base = [" ".join(f"n{rng.randrange(300)}" for _ in range(40)) for _ in range(800)]
    rows, labels = [], []
    for k, text in enumerate(base):
        toxic = int(k % 6 == 0)
        if toxic:
            text += f" Nasty{rng.randrange(9)}!"
        rows.append((k, text, None, None))
        labels.append((k, toxic))
    rows += [(None, None, None, None), (900, "", None, None), rows[0]]
    labels += [(0, 1), (None, 1), (5, None)]
    docs = frame(spark, rows)
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity_report(docs, given).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    held = got[got.doc_id.notna() & (got.doc_id < 800)]
    held = held[[zlib.crc32(str(int(i)).encode()) % 4 == 2 for i in held.doc_id]]
    assert held.held_out.all() and len(held) > 100
    assert ((held.doc_id % 6 == 0) == (held.predicted == 1)).mean() > 0.97
    kept = toxicity.keep_clean(docs, given)
    assert kept.columns == docs.columns
    assert kept.count() == (got.predicted == 0).sum()


def test_pairs_are_learned_where_each_word_alone_tells_little(spark):
    """An insult is toxic only beside a group word; group words are common and neutral."""
    rng = random.Random(17)
    letters = "abcdefghijklmnopqrstuvwxyz"
    groups = ["".join(rng.choices(letters, k=9)) for _ in range(20)]
    rows, labels, kinds = [], [], {}
    for k in range(6000):
        insult, group = rng.random() < 0.1, rng.random() < 0.5
        own = [f"n{rng.randrange(900)}" for _ in range(30)]
        if insult:
            own.insert(rng.randrange(30), "insultus")
        if group:
            own.insert(rng.randrange(30), rng.choice(groups))
        rows.append((k, " ".join(own), "en", "s0"))
        labels.append((k, int(insult and group)))
        kinds[k] = (insult, group)
    given = spark.createDataFrame(labels, "doc_id long, toxic int")
    held = [r for r in toxicity.toxicity_report(frame(spark, rows), given).collect() if r["held_out"]]
    called = lambda kind: [r["predicted"] for r in held if kinds[r["doc_id"]] == kind]
    assert np.mean(called((True, True))) > 0.9
    assert np.mean(called((True, False))) < 0.1
    assert np.mean(called((False, True)) + called((False, False))) < 0.01


def test_sample_is_bounded_in_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_SAMPLE", 50)
    rows = [(1, f"text {k}", "en", "s0") for k in range(3000)] + [(k, "words", "en", "s0") for k in range(2, 200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 200)], "doc_id long, toxic int")
    toxicity.fit(frame(spark, rows), labels, folder=str(tmp_path))
    sample = spark.read.parquet(str(tmp_path / "sample"))
    assert sample.count() == 50


def test_machine_equals_its_formula():
    """The score against the sum over all pairs of terms, written out."""
    rng = np.random.default_rng(8)
    bias, weights, vectors = 0.3, rng.normal(size=12), rng.normal(size=(12, toxicity.FACTORS))
    model = toxicity.Model(np.zeros(1, np.int16), bias, weights, vectors)
    lists = [rng.permutation(12)[: rng.integers(0, 8)] for _ in range(30)]
    rows = np.repeat(np.arange(30), [len(t) for t in lists])
    got = model.score(rows, np.concatenate(lists), 30)
    for terms, value in zip(lists, got):
        out = bias + sum(weights[t] for t in terms)
        out += sum(vectors[a] @ vectors[b] for k, a in enumerate(terms) for b in terms[:k])
        assert math.isclose(value, 1 / (1 + math.exp(-out)), rel_tol=1e-9)


def test_fit_equals_a_plain_machine():
    """The fitted numbers against Adagrad written out row by row and pair by pair."""
    rng = np.random.default_rng(12)
    lists = [np.sort(rng.permutation(6)[: rng.integers(1, 5)]) for _ in range(200)]
    labels = np.array([float(0 in t and 1 in t) for t in lists])
    got = toxicity._fit(lists, labels, 6)
    draw = np.random.default_rng(11)
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias, weights, vectors = math.log(share / (1 - share)), np.zeros(6), draw.normal(0, 0.02, (6, toxicity.FACTORS))
    seen_b, seen_w, seen_v = 1e-6, np.full(6, 1e-6), np.full(vectors.shape, 1e-6)
    for _ in range(toxicity.EPOCHS):
        order = draw.permutation(len(lists))
        for start in range(0, len(order), 128):
            step_b, step_w, step_v = 0.0, 1e-3 * weights, 1e-3 * vectors
            for k in order[start : start + 128]:
                terms = lists[k]
                out = bias + weights[terms].sum()
                out += sum(vectors[a] @ vectors[b] for i, a in enumerate(terms) for b in terms[:i])
                error = 1 / (1 + math.exp(-out)) - labels[k]
                step_b += error
                for a in terms:
                    step_w[a] += error
                    step_v[a] += error * sum((vectors[b] for b in terms if b != a), np.zeros(toxicity.FACTORS))
            seen_b, seen_w, seen_v = seen_b + step_b**2, seen_w + step_w**2, seen_v + step_v**2
            weights = weights - 0.3 * step_w / np.sqrt(seen_w)
            vectors = vectors - 0.03 * step_v / np.sqrt(seen_v)
            bias -= 0.1 * step_b / math.sqrt(seen_b)
    assert math.isclose(got[0], bias, rel_tol=1e-6)
    assert np.allclose(got[1], weights, atol=1e-6) and np.allclose(got[2], vectors, atol=1e-6)


def test_machine_learns_pairs():
    """Toxic only where an insult meets a group: each alone is as common among the others."""
    rng = np.random.default_rng(3)
    lists, labels = [], []
    for _ in range(1500):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        lists.append(np.array([0] * insult + [1] * group + [2 + int(rng.integers(5))]))
        labels.append(float(insult and group))
    bias, weights, vectors = toxicity._fit(lists, np.array(labels), 7)
    model = toxicity.Model(np.zeros(1, np.int16), bias, weights, vectors)
    one = [model.score(np.zeros(len(t), int), np.array(t), 1)[0] for t in ([0, 2], [1, 2], [0, 1, 2])]
    assert one[2] > 0.5 > max(one[:2])


def test_language_equals_plain_compression():
    """Every block compressed anew with each language's content before it."""
    import zstandard as zstd

    rng = random.Random(5)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ver", "keit"], "cc": ["ou", "eau", "que", "la"]}
    draw = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(n))
    contents = {lang: language.plain(draw(lang, 3000)) for lang in syllables}
    classifier = language.Classifier(contents)

    def sizes(data, level):
        out = []
        for content in contents.values():
            compressor = zstd.ZstdCompressor(
                level=level, dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT),
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            blocks = range(0, len(data), language.BLOCK_BYTES)
            out.append(sum(len(compressor.compress(data[k : k + language.BLOCK_BYTES])) for k in blocks))
        return out

    for n in (1, 3, 40, 4000):
        for lang in syllables:
            text = draw(lang, n)
            data = language.plain(text)
            found = sizes(data, language.LEVEL)
            if sorted(found)[0] == sorted(found)[1]:
                found = sizes(data, language.TIE_LEVEL)
            name, score, margin = classifier.predict(text)
            assert name == list(contents)[int(np.argmin(found))]
            one, two = sorted(found)[:2]
            assert math.isclose(margin, (two - one) / two) and 0.5 <= score <= 1


def test_language_sample_counts_copies_once(spark):
    texts = [" ".join(f"{w}{chr(97 + k)}" for w in ("wort", "haus", "baum", "licht", "wasser", "garten", "strasse")) for k in range(12)]
    rows = [(4 * k + j * 1000, t, "de", "s0") for k, t in enumerate(texts) for j in range(120)]
    found = language.dictionaries(frame(spark, rows))["de"].decode()
    from callweave.llm.common import fold
    from pyspark.sql import functions as F
    labelled = frame(spark, rows).filter(fold(F.col("doc_id")) != 2).select("text").distinct().collect()
    assert len(labelled) > 1 and all(r["text"] in found for r in labelled)


def test_language_learns_from_books_and_short_messages(spark):
    own = {"de": "wort haus baum licht", "fr": "maison arbre livre jardin", "en": "house tree light garden"}
    rng = random.Random(4)
    draw = lambda lang, n: " ".join(rng.choice(own[lang].split()) for _ in range(n))
    rows = [(k, draw("en", 40), "en", "s0") for k in range(20)]
    rows += [(100 + k, draw("de", 3000), "de", "s0") for k in range(8)]
    rows += [(200 + k, draw("fr", 3), "fr", "s0") for k in range(40)]
    found = language.dictionaries(frame(spark, rows))
    assert set(found) == {"de", "fr", "en"}
    for lang, content in found.items():
        assert all(w.encode() in content for w in own[lang].split())


def test_language(spark):
    import random

    rng = random.Random(2)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ver", "keit"]}
    rows = []
    for k in range(300):
        lang = rng.choice(["aa", "bb"])
        text = " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(30))
        rows.append((k, text.upper() if k % 10 == 0 else text, lang, None))
    odd = [(400, None, "aa", None), (401, "12 !!", "bb", None), (402, "", None, None), (None, "kalo mitu", None, None),
           (403, "½ ² ① Ⅷ", "aa", None)]
    got = language.language_report(frame(spark, rows + odd)).toPandas().set_index("doc_id")
    truth = {r[0]: r[2] for r in rows}
    hit = [got.lang_pred[k] == truth[k] for k in truth if got.held_out[k]]
    assert len(hit) > 40 and np.mean(hit) > 0.97
    bare = [400, 401, 402, 403]
    assert list(got.lang_pred[bare]) == ["und"] * 4 and (got.score[bare] == 0).all()
    assert got.score.between(0, 1).all()
    nothing = frame(spark, [(1, "words", None, None)])
    assert language.language_report(nothing).first()["lang_pred"] == "und"


# --- empty tables, helpers


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (
        exact_dedup.group_report(none), exact_dedup.keep_one(none), line_quality.quality_report(none),
        mixing.mix_report(none), mixing.mix(none), near_dedup.class_report(none),
        near_dedup.keep_one(none), repeats.repeat_report(none), language.language_report(none),
        toxicity.toxicity_report(none, labels), toxicity.keep_clean(none, labels),
    ):
        assert out.count() == 0


def test_word_hashes():
    import pyarrow as pa

    texts = ["a b a", None, "", " \n", "é b", "b" * 9000 + " a"]
    data, offsets = hashing.text_bytes(pa.array(texts).slice(0))
    hashes, begins = hashing.word_hashes(data, offsets)
    flat = [w for t in texts for w in WORD.findall(t or "")]
    assert len(hashes) == len(flat)
    assert list(np.diff(begins)) == [len(WORD.findall(t or "")) for t in texts]
    by_word = collections.defaultdict(set)
    for w, h in zip(flat, hashes.tolist()):
        by_word[w].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len(set().union(*by_word.values())) == len(by_word)


@pytest.mark.parametrize("module, run, kept", [
    (near_dedup, lambda docs: near_dedup.class_report(docs), {"signed", "labels", "classes"}),
    (near_dedup, lambda docs: near_dedup.keep_one(docs), {"signed", "labels", "shared"}),
    (mixing, lambda docs: mixing.mix(docs), {"keyed", "plan"}),
    (repeats, lambda docs: repeats.repeat_report(docs), {"rows", "cut", "copies"}),
])
def test_tables_that_no_result_reads_are_deleted(spark, tmp_path, monkeypatch, module, run, kept):
    rows = corpus(n=24)
    monkeypatch.setattr(module, "run_folder", lambda *_: str(tmp_path / "run"))
    out = run(frame(spark, rows))
    assert {f.name for f in (tmp_path / "run").iterdir()} <= kept
    assert out.count() > 0


def clashing(spark, rows):
    """Documents with columns under the names that the operators use themselves."""
    names = ("__score", "__size", "__key", "__tie", "__copies", "__row", "__order", "__maybe", "__sha",
             "label", "root", "bucket", "registers", "score", "target", "source_size")
    df = frame(spark, rows)
    return df.withColumns({name: F.lit(f"own {name}") for name in names}), names


def test_stages_keep_columns_that_clash(spark):
    docs, names = clashing(spark, corpus(n=30))
    labels = spark.createDataFrame([(k, int(k == 3)) for k in range(30)], "doc_id long, toxic int")
    for out in (
        toxicity.keep_clean(docs, labels), exact_dedup.keep_one(docs), near_dedup.keep_one(docs), mixing.mix(docs),
    ):
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(r[name] == f"own {name}" for r in found for name in names)


def test_no_pair_of_a_large_bucket_is_lost(spark, tmp_path, monkeypatch):
    """Also one that agrees in enough registers, but in none of a few bands of them."""
    monkeypatch.setattr(near_dedup, "FEW", 2)
    monkeypatch.setattr(near_dedup, "PIECE", 4)
    rng = np.random.RandomState(3)
    registers, pairs = [], set()
    for k in range(20):
        one = rng.randint(0, 256, near_dedup.REGISTERS).astype(np.uint8)
        two = one.copy()
        two[rng.permutation(near_dedup.REGISTERS)[:60]] += 1
        registers += [one.tobytes(), two.tobytes()]
        pairs.add((bytes([2 * k]), bytes([2 * k + 1])))
    known = spark.createDataFrame(
        [(bytearray([n]), n % 3, bytearray(r)) for n, r in enumerate(registers)],
        "node binary, lot long, registers binary",
    )
    seats = known.select(
        F.lit(5).cast("long").alias("bucket"), "node", F.lit(False).alias("ones"), F.col("node").alias("label")
    )
    near_dedup.stored(near_dedup._with_classes(seats), str(tmp_path), "seats")
    found = near_dedup._close_pairs(spark.read.parquet(f"{tmp_path}/seats"), known, str(tmp_path)).collect()
    assert sorted((bytes(r["a"]), bytes(r["b"])) for r in found) == sorted(pairs)
