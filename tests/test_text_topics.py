import itertools
import math
import random
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callweave import session
from callweave.functions import segmentation as cut, text as t
from callweave.operators import group_topics as g, topics as o, vocabulary as v
from callweave.plans.topics import transcript_terms
from callweave.sources.tables import docs_from_list
from conftest import tuples
from workload.queries import QUERIES


def test_tokenize_takes_the_longest_listed_word(spark):
    df = spark.createDataFrame([("请打个电话给Anna，打电话。ça 12_3",)], "x string")
    [row] = t.tokenize(df, "x", ["打电话", "打个电话"]).collect()
    assert row.tokens == ["请", "打个电话", "给", "Anna", "打电话", "ça", "12_3"]


def test_dictionary_equals_pattern(spark):
    words = ["征信", "上征信", "紧急联系人", "联系", "人a", "电 话", "(x)"]
    texts = ["他上征信了，紧急联系人a联系", "电 话(x)b联系人a", "", None, "🙂征信é_1"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    plain = [r.tokens for r in t.tokenize(df, "x", words).collect()]
    assert [r.tokens for r in t.tokenize(df, "x", [], dictionary=words).collect()] == plain


def test_accents(spark):
    df = spark.createDataFrame([("Été naïve Ü ｆｕｌｌ é ß",), (None,)], "x string")
    fast = [r[0] for r in df.select(t.strip_accents(F.col("x"))).collect()]
    full = [r[0] for r in df.select(t.strip_accents_full(F.col("x"))).collect()]
    assert fast == full == ["Ete naive U full e ß", None]


def test_accents_of_every_script(spark):
    rng = random.Random(3)
    code = lambda: rng.choice([rng.randrange(0x80, 0x250), rng.randrange(0x2000, 0x3400),
                               rng.randrange(0xAC00, 0xD7A4), rng.randrange(0xF900, 0xFFFF), rng.randrange(0x1D400, 0x1F250)])
    texts = ["", None, "ascii only", "한국어 각 ①ﬁ½㎡ e\u0301"] + [
        "".join(chr(code()) if rng.random() < 0.7 else rng.choice("ab \n") for _ in range(40)) for _ in range(400)
    ]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    strip = lambda x: x and "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
    got = df.select("x", t.strip_accents(F.col("x")).alias("plain"))
    assert all(r.plain == strip(r.x) for r in got.collect())
    plan = df.select(t.matrix_terms(F.col("x")))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def every_path(text, known, unknown):
    """All ways to cut a text, with their weights."""
    if not text:
        return [(0, [])]
    if "一" <= text[0] <= "龥":
        end = 1
    else:
        end = next((k for k, c in enumerate(text) if "一" <= c <= "龥"), len(text))
    ends = {end: unknown}
    for word, weight in known.items():
        if text.startswith(word):
            ends[len(word)] = max(ends.get(len(word), weight), weight)
    return [
        (weight + value, [text[:end], *rest])
        for end, weight in ends.items() for value, rest in every_path(text[end:], known, unknown)
    ]


def test_best_path_equals_exhaustive_search():
    rng = random.Random(1)
    for _ in range(600):
        draw = lambda n: "".join(rng.choices("甲乙丙a1", k=n))
        known, unknown = cut.weights([(draw(rng.randrange(1, 4)), rng.randrange(1, 30)) for _ in range(rng.randrange(9))])
        text = draw(rng.randrange(1, 9))
        best = max(every_path(text, known, unknown), key=lambda p: (p[0], [len(w) for w in p[1]]))
        assert cut.Lattice(known, unknown).cut(text) == best[1]


def test_best_path_beats_the_longest_match(spark):
    lexicon = [("研究", 60), ("研究生", 20), ("生命", 60), ("命", 5), ("起源", 40)]
    rows = [(1, "研究生命起源。hello 世界", "old"), (2, None, None), (3, "", None), (4, "!? ", None)]
    df = spark.createDataFrame(rows, "id int, x string, tokens string")
    got = {r.id: r.tokens for r in cut.segment(df, "x", lexicon).collect()}
    assert got == {1: ["研究", "生命", "起源", "hello", "世", "界"], 2: None, 3: [], 4: []}
    assert t.tokenize(df, "x", dictionary=[w for w, _ in lexicon]).first().tokens[:2] == ["研究生", "命"]
    table = spark.createDataFrame(lexicon + [("", 9), ("起", 0)], "word string, total long")
    forced = {r.id: r.tokens for r in cut.segment(df, "x", table, words=["究生", "究"]).collect()}
    assert forced[1] == ["研", "究生", "命", "起源", "hello", "世", "界"]


def test_transcript_terms_by_a_lexicon(spark):
    rows = [(1, "c1", "研究生命起源", "others", 20), (1, "c2", None, "others", 20), (1, "c3", "生命", "self", 20)]
    calls = spark.createDataFrame(rows, "owner_id long, callid string, content string, phone_type string, duration int")
    table = spark.createDataFrame([("研究", 60), ("研究生", 20), ("生命", 60), ("起源", 40)], "word string, total long")
    kept, terms = transcript_terms(calls, lexicon=table)
    assert tuples(kept, "callid") == [("c1",), ("c2",)]
    assert tuples(terms, "callid", "term") == [("c1", "生命"), ("c1", "研究"), ("c1", "起源")]


def test_lexicon_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(cut, "MAX_LEXICON_BYTES", 100)
    df = spark.createDataFrame([("x",)], "x string")
    table = spark.createDataFrame([("a", 1), ("b", 1)], "word string, total long")
    for lexicon in (table, [("a", 1), ("b", 1)]):
        with pytest.raises(ValueError):
            cut.segment(df, "x", lexicon)


def zipf_texts(spark, n=600):
    rng = np.random.RandomState(5)
    rows = [(k, [f"w{min(int(x), 4000)}" for x in rng.zipf(1.4, 30)]) for k in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [None, "w1"])]
    return spark.createDataFrame(rows, "doc_id int, tokens array<string>").repartition(6)


@pytest.mark.parametrize("size", [4, 32, 100_000])
def test_frequent_terms_equal_the_plain_count(spark, tmp_path, size):
    docs = zipf_texts(spark)
    rows = v.term_rows(docs, [], F.col("tokens")).filter("term is not null")
    want = [tuple(r) for r in v.vocabulary(rows, 25).orderBy(F.desc("total"), "term").collect()]
    got = v.frequent_terms(docs, F.col("tokens"), 25, size=size, work_dir=str(tmp_path))
    assert [tuple(r) for r in got.orderBy(F.desc("total"), "term").collect()] == want
    without = v.frequent_terms(docs, F.col("tokens"), 25, ["w1"], size=size, work_dir=str(tmp_path / "w"))
    assert "w1" not in {r.term for r in without.collect()}
    # Fewer terms than asked for: all of them.
    assert v.frequent_terms(docs, F.col("tokens"), 10**6, size=size, work_dir=str(tmp_path / "all")).count() \
        == rows.select("term").distinct().count()


def test_summaries_bound_what_is_sent(spark):
    docs = zipf_texts(spark)
    exact = {r.term: r.total for r in v.vocabulary(v.term_rows(docs, [], F.col("tokens")), None).collect()}
    summary = v.heavy_terms(docs, F.col("tokens"), 16)
    parts = summary.rdd.getNumPartitions()
    rows = summary.collect()
    assert len(rows) <= parts * 17
    lost = sum(r.low for r in rows if r.term is None)
    low = {}
    for r in rows:
        if r.term is not None:
            low[r.term] = low.get(r.term, 0) + r.low
    assert lost > 0
    assert all(low.get(t_, 0) <= n <= low.get(t_, 0) + lost for t_, n in exact.items() if t_ is not None)


def test_clean_english_keeps_stop_words_with_punctuation(spark):
    docs = docs_from_list(spark, ["The cats, and the dogs. But, the cats run"])
    [row] = t.clean_english(docs, "text", ["the", "and", "but"], {"cats": "cat"}).collect()
    assert row.tokens == ["cat", "dogs", "but", "cat", "run"]


def test_lemmatize(spark):
    terms = spark.createDataFrame([("cats",), ("dog",)], "term string")
    forms = spark.createDataFrame([("cats", "cat")], "form string, lemma string")
    assert tuples(t.lemmatize(terms, forms), "term") == [("cat",), ("dog",)]


def term_sample(spark):
    rows = [("a", 1, w) for w in "xx xx yy zz".split()] + [("a", 2, w) for w in "yy zz".split()]
    rows += [("b", 3, w) for w in "qq xx qq".split()]
    return spark.createDataFrame(rows, "owner_id string, doc_id int, term string")


def test_vocabulary_and_counts(spark):
    terms = term_sample(spark)
    assert tuples(v.vocabulary(terms, 2), "term", "total") == [("qq", 2), ("xx", 3)]
    assert tuples(v.vocabulary_by(terms, "owner_id", 1), "owner_id", "term") == [
        ("a", "xx"), ("b", "qq")]
    counts = v.doc_term_counts(terms, ["doc_id"], v.vocabulary(terms, 2))
    assert tuples(counts, "doc_id", "term", "cnt") == [(1, "xx", 2), (3, "qq", 2), (3, "xx", 1)]
    own = v.doc_term_counts(terms, ["owner_id", "doc_id"], v.vocabulary_by(terms, "owner_id", 1))
    assert tuples(own, "doc_id", "term", "cnt") == [(1, "xx", 2), (3, "qq", 2)]


def test_topic_bins_and_shares(spark):
    edges = [0.3, 0.300001, 0.7, 0.027, 0.593]
    df = spark.createDataFrame([(1, p) for p in edges], "owner_id int, topic0_prob double")
    from callweave.functions.columns import topic_bin

    assert [r[0] for r in df.select(topic_bin(F.col("topic0_prob"))).collect()] == [1, 2, 0, 1, 2]
    rows = [(1, 0.9)] * 123 + [(1, 0.1)] * 904 + [(1, 0.5)] * 276 + [(1, None)] * 4
    share = o.topic_share(spark.createDataFrame(rows, "owner_id int, topic0_prob double"))
    got = [(b, n, total, round(p, 3)) for b, n, total, p in
           tuples(share, "belong", "num", "total_call_num", "proportion")]
    assert got == [(0, 123, 1303, 0.094), (1, 904, 1303, 0.694), (2, 276, 1303, 0.212)]


def test_describe(spark):
    rows = [(0, w, x) for w, x in [("b", 2.0), ("a", 2.0), ("c", 5.0)]]
    topics = spark.createDataFrame(rows, "topic int, term string, weight double")
    assert tuples(o.describe_topics(topics, 2), "description") == [("5.0*c + 2.0*a",)]
    assert tuples(o.describe_topics(topics, 3, "words"), "description") == [("c,a,b",)]
    with pytest.raises(ValueError):
        o.describe_topics(topics, 2, "other")


SENTENCES = [
    "Rain falls on the green hills and rivers",
    "Rivers carry rain water down the hills",
    "The bank lends money at high interest",
    "Money in the bank earns interest",
    "!!",
]


def test_corpus_model(spark):
    docs = docs_from_list(spark, SENTENCES)
    terms = v.term_rows(docs, ["doc_id"], t.matrix_terms(F.col("text")))
    fit = g.fit_topics(terms, "doc_id", k=3, max_iter=5, documents=docs)
    rows = {r.doc_id: r for r in fit.documents.collect()}
    assert len(rows) == 5
    assert all(abs(r.topic0_prob + r.topic1_prob + r.topic2_prob - 1) < 1e-9 for r in rows.values())
    assert rows[5].topic0_prob == pytest.approx(1 / 3)
    total, size = terms.count(), terms.select("term").distinct().count()
    assert fit.topics.count() == 3 * size
    assert fit.topics.agg({"weight": "sum"}).first()[0] == pytest.approx(size + total)
    again = g.topic_distribution(
        fit, terms.withColumn(g.CORPUS, F.lit(0)), g.CORPUS, "doc_id",
        docs.select(F.lit(0).alias(g.CORPUS), "doc_id"),
    )
    for r in again.collect():
        assert r.topic0_prob == pytest.approx(rows[r.doc_id].topic0_prob)


def test_one_topic_counts_terms(spark):
    terms = term_sample(spark)
    fit = g.fit_topics(terms, "doc_id", k=1, max_iter=2)
    got = {r.term: r.weight for r in fit.topics.collect()}
    assert got == pytest.approx({"xx": 4, "yy": 3, "zz": 3, "qq": 3})


def test_digamma():
    x = np.array([0.01, 0.3, 1.0, 5.9, 40.0])
    step = 1e-5
    slope = [(math.lgamma(a + step) - math.lgamma(a - step)) / (2 * step) for a in x]
    assert np.allclose(g.digamma(x), slope, rtol=1e-5)
    assert g.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-11)


def dense_fit(counts, k, seed, passes):
    """One group's model by plain loops over documents, as a check."""
    weights = np.random.RandomState(seed).gamma(100.0, 0.01, (k, counts.shape[1]))
    for _ in range(passes + 1):
        beta, stats, probs = g.exp_expected_log(weights), np.zeros_like(weights), []
        for row in counts:
            at = np.nonzero(row)[0]
            gamma = np.ones(k)
            for _ in range(g.INNER_PASSES):
                theta = g.exp_expected_log(gamma[None])[0]
                phi = theta @ beta[:, at] + np.finfo(float).eps
                new = theta * (beta[:, at] @ (row[at] / phi)) + 1 / k
                done = np.abs(new - gamma).mean() < g.TOLERANCE
                gamma = new
                if done:
                    break
            theta = g.exp_expected_log(gamma[None])[0]
            phi = theta @ beta[:, at] + np.finfo(float).eps
            stats[:, at] += np.outer(theta, row[at] / phi)
            probs.append(gamma / gamma.sum())
        fitted, weights = weights, 1 / k + stats * beta
    return fitted, np.array(probs)


def group_terms(spark):
    rng = np.random.RandomState(1)
    rows = []
    for owner, n_docs in (("hot", 40), ("small", 6)):
        for doc in range(n_docs):
            pool = ["aa", "bb", "cc", "dd"] if doc % 2 else ["dd", "ee", "ff", "gg"]
            rows += [(owner, doc, w) for w in rng.choice(pool, 12)]
    return rows, spark.createDataFrame(rows, "owner_id string, doc_id int, term string")


@pytest.mark.parametrize("docs_per_chunk", [7, 1000])
def test_group_models_equal_single_models(spark, docs_per_chunk):
    rows, terms = group_terms(spark)
    fit = g.fit_topics_by_group(
        terms, "owner_id", "doc_id", k=2, seed=0, max_iter=4, docs_per_chunk=docs_per_chunk
    )
    got_docs = {(r.owner_id, r.doc_id): (r.topic0_prob, r.topic1_prob)
                for r in fit.documents.collect()}
    got_terms = {(r.owner_id, r.topic, r.term): r.weight for r in fit.topics.collect()}
    for owner in ("hot", "small"):
        own = [(d, w) for o_, d, w in rows if o_ == owner]
        words = sorted({w for _, w in own})
        docs = sorted({d for d, _ in own})
        counts = np.zeros((len(docs), len(words)))
        for d, w in own:
            counts[docs.index(d), words.index(w)] += 1
        weights, probs = dense_fit(counts, 2, 0, 4)
        for i, d in enumerate(docs):
            assert got_docs[owner, d] == pytest.approx(tuple(probs[i]), rel=1e-6)
        for topic in range(2):
            for j, w in enumerate(words):
                assert got_terms[owner, topic, w] == pytest.approx(weights[topic, j], rel=1e-6)


def test_group_documents_without_terms(spark):
    _, terms = group_terms(spark)
    documents = terms.select("owner_id", "doc_id").distinct().union(
        spark.createDataFrame([("small", 99)], "owner_id string, doc_id int")
    )
    fit = g.fit_topics_by_group(
        terms, "owner_id", "doc_id", max_iter=1, documents=documents, max_features=3
    )
    assert tuples(fit.documents.filter("doc_id = 99"), "topic0_prob") == [(0.5,)]
    assert fit.topics.groupBy("owner_id", "topic").count().filter("count > 3").count() == 0
    wide = g.attach_topics(documents, fit, "owner_id", "doc_id", n=2)
    assert wide.columns == ["owner_id", "doc_id", "topic0_prob", "topic1_prob", "topic0_words",
                            "topic1_words"]
    assert wide.count() == documents.count()
    # An agent without any vocabulary keeps its calls.
    more = documents.union(spark.createDataFrame([("new", 7)], "owner_id string, doc_id int"))
    row = g.attach_topics(more, fit, "owner_id", "doc_id").filter("owner_id = 'new'").first()
    assert row.topic0_prob == 0.5 and row.topic0_words is None


def test_relevance(spark):
    topics = spark.createDataFrame(
        [(0, "a", 3.0), (0, "b", 1.0), (1, "a", 1.0), (1, "b", 1.0)],
        "topic int, term string, weight double")
    totals = spark.createDataFrame([("a", 6), ("b", 2)], "term string, total long")
    sizes = o.topic_sizes(
        spark.createDataFrame([(1, 0, 0.75), (1, 1, 0.25)], "doc int, topic int, probability double"),
        spark.createDataFrame([(1, 8)], "doc int, length long"), "doc")
    assert tuples(sizes, "topic", "size") == [(0, 0.75), (1, 0.25)]
    rows = {(r.topic, r.term): r for r in
            o.topic_term_relevance(topics, totals, sizes, 0.5).collect()}
    a0 = rows[0, "a"]
    assert a0.relevance == pytest.approx(0.5 * math.log(0.75) + 0.5 * math.log(0.75 / 0.75))
    given = [0.75 / 1.25, 0.5 / 1.25]
    saliency = 0.75 * sum(p * math.log(p / q) for p, q in zip(given, (0.75, 0.25)))
    assert a0.saliency == pytest.approx(saliency)


def test_log_gamma():
    x = np.array([0.01, 0.2, 1.0, 3.5, 7.9, 60.0, 1e5])
    assert np.allclose(g.log_gamma(x), [math.lgamma(a) for a in x], rtol=1e-11, atol=1e-11)


def plain_bound(counts, weights):
    """The variational bound of a model, term by term."""
    k, prior = len(weights), 1 / len(weights)
    log_beta = g.digamma(weights) - g.digamma(weights.sum(axis=1, keepdims=True))
    total = 0.0
    for row in counts:
        at = np.nonzero(row)[0]
        gamma, theta = g.infer(np.zeros(len(at), int), at, row[at], np.exp(log_beta), 1)
        total += sum(n * math.log(sum(theta[0, j] * math.exp(log_beta[j, w]) for j in range(k)))
                     for w, n in zip(at, row[at]))
        for j in range(k):
            expected = float(g.digamma(gamma[0, j]) - g.digamma(gamma[0].sum()))
            total += (prior - gamma[0, j]) * expected + math.lgamma(gamma[0, j]) - math.lgamma(prior)
        total += math.lgamma(1.0) - math.lgamma(gamma[0].sum())
    for j in range(k):
        for w in range(weights.shape[1]):
            total += (prior - weights[j, w]) * log_beta[j, w] + math.lgamma(weights[j, w]) - math.lgamma(prior)
        total += math.lgamma(prior * weights.shape[1]) - math.lgamma(weights[j].sum())
    return total


def count_matrix(rows):
    words, docs = sorted({w for *_, w in rows}), sorted({d for _, d, _ in rows})
    counts = np.zeros((len(docs), len(words)))
    for _, d, w in rows:
        counts[docs.index(d), words.index(w)] += 1
    return counts, docs, words


def test_groups_stop_by_their_bound(spark, tmp_path):
    rows, terms = group_terms(spark)
    fit = g.fit_topics_by_group(
        terms, "owner_id", "doc_id", max_iter=40, tolerance=2e-3, docs_per_chunk=7, work_dir=str(tmp_path)
    )
    bounds = {}
    for r in fit.bounds.orderBy("step").collect():
        bounds.setdefault(r.owner_id, []).append(r.bound)
    assert set(bounds) == {"hot", "small"}
    for owner, own in bounds.items():
        # It rises, and the last two are as near as asked; none before was.
        steps = np.diff(own)
        assert (steps > -1e-9).all() and steps[-1] < 2e-3 and (steps[:-1] >= 2e-3).all()
        counts, docs, words = count_matrix([r for r in rows if r[0] == owner])
        first = np.random.RandomState(0).gamma(100.0, 0.01, (2, len(words)))
        assert own[0] == pytest.approx(plain_bound(counts, first) / counts.sum(), rel=1e-9)
        # The result is that of as many plain passes.
        weights, _ = dense_fit(counts, 2, 0, len(own))
        got = {(r.topic, r.term): r.weight for r in fit.topics.filter(F.col("owner_id") == owner).collect()}
        for topic, (j, w) in itertools.product(range(2), enumerate(words)):
            assert got[topic, w] == pytest.approx(weights[topic, j], rel=1e-6)
    # The group that stopped first is in none of the later tables.
    early = min(bounds, key=lambda o: len(bounds[o]))
    late = max(bounds, key=lambda o: len(bounds[o]))
    assert len(bounds[early]) < len(bounds[late])
    n = len(bounds[early])
    for step in range(n + 1, len(bounds[late]) + 1):
        assert {r.owner_id for r in spark.read.parquet(str(tmp_path / f"weights-{step}")).collect()} == {late}
    assert {r.owner_id for r in spark.read.parquet(str(tmp_path / f"chunks-{n}")).collect()} == {late}


def online_by_hand(counts, order, k, passes, offset, decay):
    weights = np.random.RandomState(0).gamma(100.0, 0.01, (k, counts.shape[1]))
    step = 0
    for _ in range(passes):
        for batch in order:
            step += 1
            rate = (offset + step) ** -decay
            beta, stats = g.exp_expected_log(weights), np.zeros_like(weights)
            for row in counts[batch]:
                at = np.nonzero(row)[0]
                if not len(at):
                    continue
                _, theta = g.infer(np.zeros(len(at), int), at, row[at], beta, 1)
                phi = theta[0] @ beta[:, at] + np.finfo(float).eps
                stats[:, at] += np.outer(theta[0], row[at] / phi) * beta[:, at]
            weights = (1 - rate) * weights + rate * (1 / k + len(counts) / len(batch) * stats)
    return weights


def test_online_fit_equals_numpy(spark):
    rows, _ = group_terms(spark)
    rows = [("c", d if o == "hot" else 100 + d, w) for o, d, w in rows]
    terms = spark.createDataFrame([r[1:] for r in rows], "doc_id int, term string")
    counts, docs, words = count_matrix(rows)
    fit = g.fit_topics_online(terms, "doc_id", k=3, passes=3, batch_docs=12, offset=4.0, decay=0.7, docs_per_chunk=5)
    n = -(-len(docs) // 12)
    number = {r.doc_id: r.b for r in terms.distinct().selectExpr("doc_id", f"pmod(xxhash64(doc_id, 0), {n}) as b").collect()}
    order = [[k for k, d in enumerate(docs) if number[d] == b] for b in sorted(set(number.values()))]
    assert sorted(itertools.chain(*order)) == list(range(len(docs))) and len(order) > 2
    want = online_by_hand(counts, order, 3, 3, 4.0, 0.7)
    got = {(r.topic, r.term): r.weight for r in fit.topics.collect()}
    assert len(got) == want.size
    for topic, (j, w) in itertools.product(range(3), enumerate(words)):
        assert got[topic, w] == pytest.approx(want[topic, j], rel=1e-6)
    assert fit.documents.count() == len(docs)


def test_all_terms_stay_where_contributions_vanish(spark):
    """With very many topics some contributions round to 0; every weight is still there."""
    rows = [(d, f"w{(d * 7 + j) % 40}") for d in range(30) for j in range(5)]
    terms = spark.createDataFrame(rows, "doc_id int, term string")
    fit = g.fit_topics(terms, "doc_id", k=400, max_iter=3)
    assert fit.topics.count() == 400 * 40


def divergence(p, q):
    m = (p + q) / 2
    part = lambda x: sum(a * math.log(a / b) for a, b in zip(x, m) if a > 0)
    return (part(p) + part(q)) / 2


def test_topic_map(spark):
    rng = np.random.RandomState(4)
    weights = rng.gamma(0.4, 1.0, (6, 30)) * (rng.random_sample((6, 30)) < 0.6)
    weights[5, :20], weights[4, 20:] = 0, 0
    rows = [(k, f"w{j}", float(weights[k, j])) for k in range(6) for j in range(30)]
    topics = spark.createDataFrame(rows, "topic int, term string, weight double")
    p = weights / weights.sum(axis=1, keepdims=True)
    got = {(r.topic_a, r.topic_b): r.distance for r in o.topic_distances(topics).collect()}
    assert set(got) == set(itertools.combinations(range(6), 2))
    for (a, b), value in got.items():
        assert value == pytest.approx(divergence(p[a], p[b]), rel=1e-9)
    sizes = spark.createDataFrame([(k, k / 15) for k in range(6)], "topic int, size double")
    places = {r.topic: (r.x, r.y) for r in o.topic_map(topics, sizes).collect()}
    d = np.zeros((6, 6))
    for (a, b), value in got.items():
        d[a, b] = d[b, a] = value
    centred = -(d**2 - (d**2).mean(0) - (d**2).mean(1)[:, None] + (d**2).mean()) / 2
    values = np.sort(np.linalg.eigvalsh(centred))[::-1]
    x = np.array([places[k] for k in range(6)])
    assert np.allclose(x.T @ x, np.diag(values[:2]), atol=1e-9)
    assert np.allclose(centred @ x, x * values[:2], atol=1e-9)


def test_scaling_keeps_plane_distances():
    points = np.array([[0, 0], [3, 0], [0, 4], [-2, 1], [5, 5.0]])
    d = np.sqrt(((points[:, None] - points) ** 2).sum(axis=2))
    found = o.scaled(d)
    assert np.allclose(np.sqrt(((found[:, None] - found) ** 2).sum(axis=2)), d)
    assert np.allclose(o.scaled(np.zeros((1, 1))), 0) and np.allclose(o.scaled(np.zeros((3, 3))), 0)


def test_map_of_few_topics(spark):
    one = spark.createDataFrame([("a", "w", 1.0)], "topic string, term string, weight double")
    sizes = spark.createDataFrame([("a", 1.0)], "topic string, size double")
    assert tuples(o.topic_map(one, sizes), "topic", "x", "y", "size") == [("a", 0.0, 0.0, 1.0)]
    assert o.topic_map(one.filter("false"), sizes).collect() == []
    two = spark.createDataFrame([("a", "w", 1.0), ("b", "v", 2.0)], one.schema)
    [pair] = o.topic_distances(two).collect()
    assert pair.distance == pytest.approx(math.log(2))
    x = [r.x for r in o.topic_map(two, sizes).collect()]
    assert abs(x[0] - x[1]) == pytest.approx(math.log(2))


def test_chunks_of_a_group_are_worked_on_together(monkeypatch):
    """Up to a bound of entries, so that the work per document does not hang on chunks' sizes."""
    rng = np.random.RandomState(2)
    weights, rows = rng.gamma(100.0, 0.01, (2, 30)), []
    for chunk in range(12):
        doc = np.repeat(np.arange(chunk * 4, chunk * 4 + 4), 5)
        rows.append(("ab"[chunk % 2], doc, rng.randint(0, 30, 20), rng.randint(1, 4, 20), weights.ravel()))
    batch = pd.DataFrame(rows, columns=["owner_id", "doc", "term_no", "cnt", "weights"])
    for bound, blocks in ((10_000, 2), (60, 4), (1, 12)):
        monkeypatch.setattr(g, "BLOCK", bound)
        found = list(g._blocks(batch, "owner_id", 2))
        assert len(found) == blocks
        assert sorted(d for _, ids, *_ in found for d in ids) == list(range(48))
        sums = np.zeros((2, 30))
        for _, _, doc, term, count, own in found:
            terms, added, _ = g.contributions(doc, term, count, own)
            sums[:, terms] += added
        assert sums.sum() == pytest.approx(sum(r[3].sum() for r in rows))


def test_an_online_step_is_one_job(spark):
    _, terms = group_terms(spark)
    terms = terms.withColumn("doc_id", F.concat("owner_id", "doc_id"))

    def jobs(passes):
        name = f"online-{passes}"
        spark.sparkContext.setJobGroup(name, name)
        fit = g.fit_topics_online(terms, "doc_id", k=2, passes=passes, batch_docs=12)
        spark.sparkContext.setJobGroup("other", "other")
        assert fit.topics.count() == 2 * 7
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    # Some batches more: a job for each.
    assert jobs(6) - jobs(2) == 4 * 4


def test_an_online_step_is_not_planned_as_a_query(spark):
    rows = [(d, w) for d in range(48) for w in ("xx", "yy", f"w{d % 5}")]
    terms = spark.createDataFrame(rows, "doc_id int, term string")

    def last_query():
        terms.count()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        # Early ones are dropped from the list, so the number is told by the last.
        return spark._jsparkSession.sharedState().statusStore().executionsList().last().executionId()

    def queries(passes):
        before = last_query()
        g.fit_topics_online(terms, "doc_id", k=2, passes=passes, batch_docs=12)
        return last_query() - before

    assert queries(5) == queries(1) > 0


def test_held_chunks_add_what_chunks_from_files_add(spark):
    rng = np.random.default_rng(5)
    rows = []
    for batch, chunk in itertools.product(range(3), range(5)):
        docs = [d for d in ([None] if chunk == 4 else []) + [f"{batch} {chunk} {d}" for d in range(4)] for _ in range(6)]
        count = rng.integers(1, 9, len(docs))
        count[0] = 100_000 * chunk + 1
        rows.append((0, batch, chunk, docs, rng.integers(0, 300, len(docs)).tolist(), count.tolist()))
    chunks = spark.createDataFrame(rows, "corpus int, batch int, chunk long, doc array<string>, term_no array<int>, cnt array<long>")
    weights = rng.gamma(100.0, 0.01, (2, 300))
    held = g._held(chunks, 3, 2)
    for batch in range(3):
        got = g._step_sums(held, range(2 * batch, 2 * batch + 2), weights)
        want = g._sums(chunks.filter(F.col("batch") == batch), weights)
        assert want.sum() == pytest.approx(sum(sum(r[5]) for r in rows if r[1] == batch))
        assert got == pytest.approx(want, rel=1e-9)


def test_letters_without_decomposition_stay_beside_others(spark):
    """In one text, with and without characters that become several."""
    texts = ["Straße naïve Ærø", "ﬁn Straße é", "강 ß ü", "é – ok", "½ Œuvre"]
    got = docs_from_list(spark, texts).orderBy("doc_id").select(t.strip_accents(F.col("text"))).collect()
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    assert [r[0] for r in got] == [plain(s) for s in texts]


def test_chunks_of_a_fit_are_spread_over_files(spark, tmp_path, monkeypatch):
    """A table of few bytes, but each of its rows costs a hundred inner passes: all cores work on them."""
    rows = [("a", d, w) for d in range(64) for w in ("xx", "yy", f"w{d % 5}")]
    terms = spark.createDataFrame(rows, "owner_id string, doc_id int, term string")
    monkeypatch.setattr(g, "drop_folder", lambda spark, path: None)
    g.fit_topics_by_group(terms, "owner_id", "doc_id", max_iter=1, docs_per_chunk=4, work_dir=str(tmp_path))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    assert len(chunks.inputFiles()) > 4
    for row in chunks.collect():  # the entries of a document stand together
        assert row.doc == sorted(row.doc)
    with g.finer_scans(spark):
        parts = spark.read.parquet(str(tmp_path / "chunks")).rdd.getNumPartitions()
    assert parts > 4 and spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_inference_equals_that_of_single_documents(monkeypatch):
    """In panels of documents of other lengths, in any order of the entries."""
    rng = np.random.RandomState(4)
    beta = g.exp_expected_log(rng.gamma(1.0, 1.0, (3, 50)))
    rows = [(d, w, n) for d in range(40) if d != 7
            for w, n in zip(rng.permutation(50)[: 1 + d], rng.randint(1, 9, 1 + d).astype(float))]
    doc, term, count = (np.array(x) for x in zip(*rng.permutation(np.array(rows, dtype=object))))
    doc, term, count = doc.astype(int), term.astype(int), count.astype(float)
    monkeypatch.setattr(g, "PANEL", 100)
    gamma, theta = g.infer(doc, term, count, beta, 40)
    assert np.allclose(theta, g.exp_expected_log(gamma), rtol=1e-9, atol=1e-300)
    assert (gamma[7] == 1 / 3).all()
    for d in set(range(40)) - {7}:
        at, weights = doc == d, np.ones(3)
        for _ in range(g.INNER_PASSES):
            own = g.exp_expected_log(weights[None])[0]
            new = own * (beta[:, term[at]] @ (count[at] / (own @ beta[:, term[at]]))) + 1 / 3
            near, weights = np.abs(new - weights).mean() < g.TOLERANCE, new
            if near:
                break
        assert gamma[d] == pytest.approx(weights, rel=1e-9)


def test_equal_pieces_are_cut_once():
    """Also those of other batches; rows keep their order, null and empty ones stay."""
    seen, kept = [], {}

    def letters(piece):
        seen.append(piece)
        return list(piece)

    kind = pa.list_(pa.string())
    for rows in ([["ab", "c"], None, [], ["ab"]], [["c", "", "ab", "d"], None]):
        got = t.tokens_of_pieces(pa.array(rows, kind), letters, kept)
        assert got.to_pylist() == [r if r is None else [x for p in r for x in p] for r in rows]
    assert sorted(seen) == ["", "ab", "c", "d"]
    assert t.tokens_of_pieces(pa.array([], kind), letters, kept).to_pylist() == []


@pytest.mark.parametrize("words", [["ab", "abc", "今天"], ["ab", "b c", "今天"]])
def test_longest_match_of_runs_equals_that_of_texts(spark, words):
    """A lexicon with words beyond a run of word characters is matched over whole texts."""
    texts = ["abc ab, b cab 今天好", None, "", "xab cd_é今今天 abcabc", "a-b c"]
    got = t.tokenize(docs_from_list(spark, texts), "text", dictionary=words).orderBy("doc_id")
    listed = sorted(words, key=lambda w: -len(w))
    plain = re.compile("|".join([*listed, "[一-龥]", r"[^\W一-龥]+"]))
    assert [r.tokens for r in got.collect()] == [None if x is None else plain.findall(x) for x in texts]


def test_a_lexicon_table_is_computed_once(spark):
    """Its size is checked and its words are read, though it may come from all texts."""
    for segmented in (
        lambda d, w: t.tokenize(d, "text", dictionary=w), lambda d, w: cut.segment(d, "text", w)
    ):
        rows = spark.sparkContext.accumulator(0)

        def count(word):
            rows.add(1)
            return word

        words = spark.createDataFrame([("ab", 3), ("cd", 4)], "word string, total long")
        words = words.withColumn("word", F.udf(count).asNondeterministic()("word"))
        assert [r.tokens for r in segmented(docs_from_list(spark, ["abcd"]), words).collect()] == [["ab", "cd"]]
        assert rows.value == 2


@pytest.mark.parametrize("name", ["l6_topic_distances", "l6_topic_term_relevance", "l6_model_relevance"])
def test_explorer_figures_come_from_stored_sums(spark, name):
    """The texts are split while the sums are made, not again wherever these are read."""
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert found.inputFiles() and not [f for f in found.inputFiles() if "documents.parquet" in f]


def listed_terms(spark):
    """Texts with their terms as arrays: two texts of a key, repeats, nothing, NULL, a group of NULL."""
    rows = [("a" if d % 3 else "b", d % 25, ["xx", "yy", f"w{d % 7}", "xx", None][: d % 6]) for d in range(40)]
    rows += [("a", 30, []), ("a", 31, None), (None, 32, ["xx", "zz"])]
    return spark.createDataFrame(rows, "owner_id string, doc_id int, terms array<string>")


def occurrences(texts):
    return v.term_rows(texts, ["owner_id", "doc_id"], F.col("terms")).filter("term is not null")


@pytest.mark.parametrize("sums", [1 << 20, 3])
def test_counts_per_text_equal_counted_occurrences(spark, monkeypatch, sums):
    """Also where a task sends its sums on early; neither counts nor sums are shuffled."""
    monkeypatch.setattr(v, "SUMS", sums)
    texts, keys = listed_terms(spark), ["owner_id", "doc_id"]
    found = v.text_counts(texts, *keys)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    pairs = found.filter("cnt is null").select(*keys, F.inline(F.arrays_zip("terms", "cnts")).alias("term", "cnt"))
    summed = pairs.groupBy(*keys, "term").agg(F.sum("cnt").alias("cnt"))
    names = [*keys, "term", "cnt"]
    assert tuples(summed, *names) == tuples(v.doc_term_counts(occurrences(texts), keys), *names)
    totals = v.vocabulary_by(found.filter("cnt is not null"), "owner_id", 100, "cnt")
    names = ["owner_id", "term", "total"]
    assert tuples(totals, *names) == tuples(v.vocabulary_by(occurrences(texts), "owner_id", 100), *names)


def test_fits_on_arrays_equal_fits_on_rows(spark):
    texts = listed_terms(spark)
    rows = occurrences(texts)
    listed = texts.select("owner_id", "doc_id").distinct()

    def same(one, two, *names):
        one, two = tuples(one, *names), tuples(two, *names)
        assert len(one) == len(two) > 0
        for a, b in zip(one, two):
            assert a == pytest.approx(b, rel=1e-6) if not isinstance(a[0], str) else (
                a[:-1] == b[:-1] and a[-1] == pytest.approx(b[-1], rel=1e-6))

    by = [g.fit_topics_by_group(x, "owner_id", "doc_id", max_iter=3, max_features=6, documents=listed)
          for x in (texts, rows)]
    same(by[0].topics, by[1].topics, "owner_id", "topic", "term", "weight")
    same(by[0].documents.filter("owner_id is not null"), by[1].documents.filter("owner_id is not null"),
         "owner_id", "doc_id", "topic0_prob")
    whole = [g.fit_topics(x, "doc_id", k=2, max_iter=3) for x in (texts, rows)]
    same(whole[0].topics.select(F.col("term"), "topic", "weight"), whole[1].topics.select("term", "topic", "weight"),
         "term", "topic", "weight")
    same(whole[0].documents, whole[1].documents, "doc_id", "topic0_prob")
    online = [g.fit_topics_online(x, "doc_id", k=2, passes=2, batch_docs=9) for x in (texts, rows)]
    same(online[0].topics, online[1].topics, "term", "topic", "weight")


def reader_batches(df):
    """Rows of a parquet table, and the batches in which its reader decodes them."""
    run = df._jdf.queryExecution()
    rows, plan = run.toRdd().count(), run.executedPlan()
    while plan.nodeName() != "ColumnarToRow":
        plan = plan.children().head()
    return rows, plan.metrics().apply("numInputBatches").value()


def test_few_chunks_are_decoded_at_once(spark, monkeypatch):
    """A chunk is a row of many documents, so that the reader's rows are bounded by their documents."""
    monkeypatch.setattr(session, "READ_ROWS", 8)
    seen = {"online": [], "batch": []}
    sums, passed = g._sums, g._pass
    monkeypatch.setattr(g, "_sums", lambda c, w: seen["online"].append(reader_batches(c)) or sums(c, w))
    monkeypatch.setattr(g, "_pass", lambda c, *a: seen["batch"].append(reader_batches(c)) or passed(c, *a))
    rows = [(0, d, w) for d in range(320) for w in ("xx", "yy", f"w{d % 5}")]
    terms = spark.createDataFrame(rows, "owner_id int, doc_id int, term string")
    g.fit_topics_online(terms, "doc_id", k=1, passes=1, batch_docs=1000, docs_per_chunk=4)
    g.fit_topics_by_group(terms, "owner_id", "doc_id", max_iter=1, docs_per_chunk=8)
    for (chunks, batches), most in ((seen["online"][0], 2), (seen["batch"][0], 1)):
        assert chunks > 20 and chunks <= most * batches
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize", None) is None
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "2000"
