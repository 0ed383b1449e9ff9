"""Token ids, packing, token files and chat trees: exact round trips."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import corpus, frame, words
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from callweave import session
from callweave.llm import chat, packing, tokenbin
from callweave.llm.tokens import CachedTokenizer

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PATHS = [BYTES, public_tokenizers.path("word_bpe_49k.json")]
CACHED = {p: CachedTokenizer(p) for p in PATHS}


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


PLAIN = {p: Tokenizer.from_file(p) for p in PATHS}
ALPHABET = st.sampled_from(list("abÀé.,'s \n\t  !#☃\x1c\u3000\u00a0ΣŁ9") + ["☃☃", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'ll", "\u0301"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=1, max_size=4))
def test_cached_ids_equal_the_library(texts):
    for path in PATHS:
        ids, offsets = CACHED[path].encode(pa.array(texts))
        got = [ids[offsets[k] : offsets[k + 1]].tolist() for k in range(len(texts))]
        assert got == [ids_of(PLAIN[path], t) for t in texts]


def test_cache_starts_anew(monkeypatch):
    from callweave.llm import tokens

    monkeypatch.setattr(tokens, "KEPT_PIECES", 5)
    fresh = CachedTokenizer(BYTES)
    for k in range(12):
        ids, offsets = fresh.encode(pa.array([f"one two{k} three{k} four {k}", None, ""]))
        assert ids[: offsets[1]].tolist() == ids_of(PLAIN[BYTES], f"one two{k} three{k} four {k}")
        assert offsets.tolist()[1:] == [len(ids)] * 3


def plain_best_two_fit(lengths, capacity):
    """The method as it is told, over lists: fill greedily, then try every two for the smallest."""
    left, bins = sorted(lengths), []
    while left:
        own, gap = [], capacity
        while any(n <= gap for n in left):
            own.append(max(n for n in left if n <= gap))
            left.remove(own[-1])
            gap -= own[-1]
        room = gap + own[-1]
        pairs = [
            (x + y, x, y) for i, x in enumerate(left) for j, y in enumerate(left)
            if i != j and own[-1] < x + y <= room
        ]
        if gap and pairs and room < capacity:
            _, x, y = max(pairs)
            left.append(own.pop())
            left.remove(x)
            left.remove(y)
            own += [x, y]
        bins.append(own)
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_bins_equal_the_plain_method(lengths):
    got = [[lengths[k] for k in b] for b in packing.best_two_fit(lengths, 20)]
    assert got == plain_best_two_fit(lengths, 20)


def test_special_strings_have_their_own_ids():
    texts = ["x <|endoftext|> y", "plain text", None, "<|endoftext|>", "", "a<|startoftext|>b"]
    for path in PATHS:
        ids, offsets = CACHED[path].encode(pa.array(texts))
        for k, text in enumerate(texts):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == ids_of(PLAIN[path], text)
    ids, _ = CACHED[BYTES].encode(pa.array(["x <|endoftext|> y"]))
    assert 50256 in ids


# --- packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_bins_hold_every_length_once(lengths):
    bins = packing.best_two_fit(lengths, 30)
    assert sorted(itertools.chain(*bins)) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in b) <= 30 for b in bins)
    first_fit = []
    for n in sorted(lengths, reverse=True):
        for k, room in enumerate(first_fit):
            if n <= room:
                first_fit[k] -= n
                break
        else:
            first_fit.append(30 - n)
    assert len(bins) <= len(first_fit) + 1


def test_smallest_is_replaced_by_two():
    # Greedy: 6 + 3, one short of 10. The 3 gives way to 2 + 2.
    lengths = [6, 3, 2, 2]
    bins = packing.best_two_fit(lengths, 10)
    assert sorted(lengths[k] for k in bins[0]) == [2, 2, 6]


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pack(spark, capacity):
    rows = corpus()
    docs = frame(spark, rows).repartition(3)
    path = PATHS[1]
    got = packing.pack(docs, path, capacity=capacity).toPandas()
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        ids = ids_of(PLAIN[path], text) + [0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    found = collections.Counter(
        (None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
        for r in got.itertuples()
    )
    assert found == want
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == list(np.cumsum(own.length) - own.length)
        assert own.length.sum() <= capacity
    least = -(-int(got.length.sum()) // capacity)
    assert got.sequence_id.nunique() <= least * 1.02 + 2
    assert packing.pack(frame(spark, []), path).count() == 0


# --- token files


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 40_000), st.integers(0, 10))
def test_blocks_round_trip(vocabulary, n, seed):
    rng = np.random.default_rng(seed)
    ids = (rng.zipf(1.4, n) % vocabulary).astype(np.uint32)
    counts = np.bincount(ids, minlength=vocabulary) if seed % 2 else np.zeros(vocabulary, np.int64)
    table = tokenbin.Table(counts)
    assert int(table.freq.sum()) == 1 << tokenbin.SCALE_BITS and (table.freq > 0).all()
    payload = tokenbin.encode_block(ids, table)
    assert (tokenbin.decode_block(payload, table) == ids).all()


def test_parts_decode_alone_and_damage_shows():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.3, 300_000) % 1000).astype(np.uint32)
    table = tokenbin.Table(np.bincount(ids, minlength=1000))
    payload = tokenbin.encode_block(ids, table)
    size = tokenbin.CHECKPOINT_STEPS * tokenbin.LANES
    for part in (2, 0, 1):
        assert (tokenbin.decode_part(payload, table, part) == ids[part * size : (part + 1) * size]).all()
    entropy = -sum(p * np.log2(p) for p in np.bincount(ids) / len(ids) if p) * len(ids) / 8
    assert len(payload) < entropy * 1.05 + 3 * (4 + 8 * tokenbin.LANES)
    broken = bytearray(payload)
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError):
        tokenbin.decode_block(bytes(broken), table)


def test_token_files(spark, tmp_path):
    rows = corpus()
    docs = frame(spark, rows).repartition(3)
    tokenbin.write(docs, BYTES, str(tmp_path / "t"))
    got = tokenbin.read(spark, str(tmp_path / "t"), BYTES).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = np.array(ids_of(PLAIN[BYTES], text) + [0], "<u4")
        kept = zlib.crc32(ids.astype("<u2").tobytes())
        want.append((doc_id is None, doc_id or 0, kept, len(ids), zlib.crc32(ids.tobytes()), doc_id))
    start, expected = 0, []
    for _, _, _, n, crc, doc_id in sorted(want, key=lambda w: w[:3]):
        expected.append((doc_id, start, n, crc))
        start += n
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == expected
    tokenbin.write(frame(spark, []), BYTES, str(tmp_path / "none"))
    assert tokenbin.read(spark, str(tmp_path / "none"), BYTES).count() == 0


# --- chat


def test_turns_round_trip():
    odd = [r"\### Assistant: </turn> ok", "", "#### \\\\", "</turn>\n### user: x", ":\\:", "a\\"]
    for role, text in itertools.product(odd, odd):
        whole = "".join(chat.format_turn(role, text))
        assert chat.parse_turn(whole) == (role, text)
        assert "</turn>" not in whole[: -len("</turn>\n")].replace("\\</turn>", "")


def conversations(seed=1, n=80):
    rng = random.Random(seed)
    openings = [words(rng, 12) for _ in range(4)]
    rows = []
    for k in range(n):
        texts = [openings[0] if k % 3 else rng.choice(openings), rng.choice(openings)]
        texts += [words(rng, rng.randrange(20)) for _ in range(rng.randrange(5))]
        rows += [(k, t, ["user", "assistant"][t % 2], x) for t, x in enumerate(texts)]
    rows += [(k + 200, t, r, x) for k, t, r, x in rows if k < 20]
    rows += [(500, 0, "user", None), (500, 1, "assistant", None), (501, None, None, "late"), (501, 3, "assistant", "###"),
             (None, 0, "user", "no id"), (None, None, None, None), (502, 0, "tool:x\\", "é" * 3), (502, 0, "tool:x\\", "é" * 3)]
    rng.shuffle(rows)
    return rows


def digest(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    size = sum(len("".join(chat.format_turn(r, t))) for r, t in turns)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(said), len(loss), sha(loss), size


def test_chat(spark):
    rows = conversations()
    table = spark.createDataFrame(
        [(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, path string"
    )
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is None, turn or 0, role or "", text or ""))
    want = {(c, *digest([t[2:] for t in sorted(g)])) for c, g in groups.items()}
    got = chat.chat_report(table, BYTES).collect()
    assert len(got) == len(groups) and {tuple(r) for r in got} == want
    blocks = chat.build_blocks(table.repartition(2), BYTES).collect()
    tree = sum(len(b["ids"]) for b in blocks)
    flat = sum(len(ids_of(PLAIN[BYTES], "".join(chat.format_turn(*t[2:])))) for g in groups.values() for t in g)
    assert tree < 0.8 * flat
    for b in blocks:
        for last in b["last_turns"]:
            seen = b["attention"][last]
            positions = [b["positions"][k] for s, e in zip(seen[::2], seen[1::2]) for k in range(s, e)]
            assert positions == list(range(len(positions)))
    none = spark.createDataFrame([], table.schema)
    assert chat.chat_report(none, BYTES).count() == 0


def test_few_blocks_are_decoded_at_once(spark, monkeypatch):
    """A block is a row of many conversations, so that the reader's rows are bounded by these."""
    monkeypatch.setattr(session, "READ_ROWS", 8)
    monkeypatch.setattr(chat, "BLOCK_CONVERSATIONS", 4)
    seen, handed, back = [], spark.sparkContext.accumulator(0), chat.read_back

    def watched(blocks, path):
        run = blocks._jdf.queryExecution()
        rows, plan = run.toRdd().count(), run.executedPlan()
        while plan.nodeName() != "ColumnarToRow":
            plan = plan.children().head()
        seen.append((rows, plan.metrics().apply("numInputBatches").value()))

        def count(batches):
            for batch in batches:
                handed.add(1)
                yield batch

        return back(blocks.mapInArrow(count, blocks.schema), path)

    monkeypatch.setattr(chat, "read_back", watched)
    rows = [(k, t, ["user", "assistant"][t], f"{k} {t}") for k in range(160) for t in range(2)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = chat.chat_report(table, BYTES)
    assert {tuple(r) for r in got.collect()} == {
        (k, *digest([r[2:] for r in rows if r[0] == k])) for k in range(160)
    }
    [(blocks, decoded)] = seen
    assert blocks >= 40 and blocks <= 2 * decoded and blocks <= 2 * handed.value
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize", None) is None


def test_small_blocks_hold_the_same():
    rows = conversations()
    groups = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            groups[conv].append((turn is None, turn or 0, role or "", text or ""))
    encoder = chat._encoder(BYTES)
    block = chat._Block()
    for conv, g in groups.items():
        turns = [t[2:] for t in sorted(g)]
        keys = [hashlib.md5(repr(t).encode()).digest() for t in turns]
        parts = []
        for r, t in turns:
            head, body, tail = chat.format_turn(r, t)
            parts.append([(False, ids_of(encoder, head)), (r == "assistant", ids_of(encoder, body)), (False, ids_of(encoder, tail))])
        block.add(conv, keys, parts)
    batch = block.batch()
    row = {name: batch.column(name)[0].values for name in chat.BLOCKS.names}
    got = chat._digest(row, encoder).to_pylist()
    assert {tuple(r.values()) for r in got} == {(c, *digest([t[2:] for t in sorted(g)])) for c, g in groups.items()}
