"""The pipeline stage by stage, each held against what its own input should give."""

import collections
import zlib

import numpy as np
import public_tokenizers
from helpers import corpus, family, frame
from test_documents import WORD, probability_jaccard, shingle_counts
from tokenizers import Tokenizer

import corpus_pipeline
from callweave.llm import mixing, near_dedup, toxicity


def test_stages(spark, tmp_path):
    rows = corpus(seed=8, n=50)
    docs = frame(spark, rows).drop("size", "node", "tag")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, int(k == 3)) for k in range(40)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    given = spark.read.parquet(str(tmp_path / "documents.parquet"))
    folder, after = str(tmp_path), {}
    now = given
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, folder).write.parquet(f"{folder}/{name}")
        before, now = now, spark.read.parquet(f"{folder}/{name}")
        after[name] = (before.collect(), now.collect())
        if name != "packing":
            assert now.columns == given.columns

    before, kept = after["toxicity"]
    model = toxicity.fit(given, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = {r["text"]: r["__score"] for r in toxicity.score(given.select("text"), model).collect()}
    clean = [r for r in before if scores[r["text"]] < toxicity.THRESHOLD]
    assert collections.Counter(kept) == collections.Counter(clean)

    before, kept = after["exact_dedup"]
    assert len(kept) == len({r["text"] or "" for r in before})
    assert {r["text"] or "" for r in kept} == {r["text"] or "" for r in before}

    before, kept = after["near_dedup"]
    sets = {r: shingle_counts(r["text"]) for r in before}

    def near(a, b):
        x, y = sets[a], sets[b]
        if not x or not y or not x.keys() & y.keys():
            return False
        plain = len(x.keys() & y.keys()) / len(x.keys() | y.keys())
        return max(plain, probability_jaccard(x, y)) >= near_dedup.SIMILARITY

    assert not any(near(a, b) for k, a in enumerate(kept) for b in kept[:k])
    gone = [r for r in before if r not in kept]
    assert gone and all(any(near(r, other) for other in before if other is not r) for r in gone)

    before, kept = after["mixing"]
    taken = collections.Counter(r["doc_id"] for r in kept if WORD.search(r["text"] or ""))
    assert max(collections.Counter((r["doc_id"], r["text"]) for r in kept).values()) <= 2
    for source in {r["source"] for r in before}:
        own = [r for r in before if r["source"] == source]
        size = sum(len(WORD.findall(r["text"] or "")) for r in own)
        mixed = sum(len(WORD.findall(r["text"] or "")) for r in kept if r["source"] == source)
        assert mixed <= 2 * size
    report = mixing.mix_report(spark.createDataFrame(before, given.schema)).collect()
    want = collections.Counter()
    for r in report:
        want[r["doc_id"]] += r["taken"] // max(r["size"], 1)
    assert taken == +want
    # Every source's complete epochs hold its documents without words as well.
    for r in before:
        if not WORD.search(r["text"] or ""):
            own = [q for q in report if q["source"] == r["source"]]
            whole = own[0]["target"] >= own[0]["source_size"]
            assert not whole or r in kept

    before, packed = after["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for r in before:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for start in range(0, len(ids), 2048):
            part = np.array(ids[start : start + 2048], "<u4")
            want[r["doc_id"], start, len(part), zlib.crc32(part.tobytes())] += 1
    assert want == collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed)

    whole = corpus_pipeline.run(spark, folder).collect()
    pieces = lambda rows_: collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows_)
    assert pieces(whole) == pieces(packed)


def test_near_stage_keeps_one_of_a_large_family(spark):
    rows = family(400, seed=5)
    kept = corpus_pipeline.near(spark, frame(spark, rows), "").collect()
    assert [r["doc_id"] for r in kept] == [0]
