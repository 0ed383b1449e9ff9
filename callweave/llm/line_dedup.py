"""Removal of lines that stand in many documents, by sharded minimal perfect hashing.

A line's key is the line without ASCII white space at both ends, A-Z in lower case; two
64-bit hashes stand for it. Documents send their distinct hashes, added up per task, to be
counted; of the distinct hashes that reach the limit an index is built. It is cut into
shards by hash, and each shard has a minimal perfect hash (levels of bits, a key ends at
the first level where no other shares its bit; the rank of the bit is its number), a
fingerprint array and an array of counts at that number. Documents probe the arrays where
they are read: no line is joined, and no text is shuffled.

The arrays go to all tasks at once if their measured size is within a bound; a larger
index is probed in parts of that size, each a pass over the documents' stored hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from callweave.llm import hashing
from callweave.llm.common import run_folder, stored, tidy

MIN_DOCUMENTS = 10
MIN_CHARS = 1
#: Keys of a shard, about.
SHARD_KEYS = 1 << 16
#: Bits per key at each level of a minimal perfect hash.
GAMMA = 2.0
#: Bound of the arrays that a task holds at once.
MAX_INDEX_BYTES = 128 << 20
#: Hashes that a task adds up before it sends them.
HELD_HASHES = 1 << 20
_TURN = np.uint8(0xA5)


def lines_of(texts: pa.Array, min_chars: int = MIN_CHARS) -> Iterator[tuple]:
    """Per chunk of texts: first and last row, its bytes, the begin, end and text of each line,
    two hashes of its key, and whether the key has ``min_chars`` code points."""
    data, offsets = hashing.text_bytes(texts)
    for lo, hi in hashing.chunks(offsets):
        own = offsets[lo : hi + 1] - offsets[lo]
        part = data[offsets[lo] : offsets[hi]]
        feeds = np.flatnonzero(part == 10)
        # A line begins with its text and after each feed.
        begins = np.sort(np.concatenate([own[:-1], feeds + 1]), kind="stable")
        rows = np.repeat(np.arange(hi - lo), np.diff(np.searchsorted(feeds, own)) + 1)
        ends = np.empty_like(begins)
        ends[:-1] = begins[1:] - 1
        last = np.cumsum(np.bincount(rows, minlength=hi - lo)) - 1
        ends[last] = own[1:]
        folded = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint8)
        solid = np.flatnonzero(~hashing.WHITE[part])
        first, after = np.searchsorted(solid, begins), np.searchsorted(solid, ends)
        some = after > first
        at = np.append(solid, 0)
        key_begin = np.where(some, at[np.minimum(first, len(solid))], begins)
        key_end = np.where(some, at[np.maximum(after - 1, 0)] + 1, begins)
        hashes = [
            hashing.range_hashes(hashing.prefix_hashes(folded ^ turn), key_begin, key_end)
            for turn in (np.uint8(0), _TURN)
        ]
        chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        yield lo, hi, part, begins, ends, rows, *hashes, chars[key_end] - chars[key_begin] >= min_chars


def count_batches(min_chars: int):
    """text -> one, other, n: distinct keys of each document, added up."""
    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        one, other, n = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((other, one))
        one, other, n = one[order], other[order], n[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (other[1:] != other[:-1])
        at = np.flatnonzero(new)
        n = np.add.reduceat(n, at) if len(at) else n
        return pa.RecordBatch.from_arrays(
            [pa.array(one[at].view(np.int64)), pa.array(other[at].view(np.int64)), pa.array(n)],
            ["one", "other", "n"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, _, _, _, rows, one, other, valid in lines_of(batch.column("text"), min_chars):
                rows, one, other = rows[valid], one[valid], other[valid]
                order = np.lexsort((other, one, rows))
                rows, one, other = rows[order], one[order], other[order]
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (one[1:] != one[:-1]) | (other[1:] != other[:-1])
                held.append((one[new], other[new], np.ones(int(new.sum()), np.int64)))
                size += int(new.sum())
                if size > HELD_HASHES:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    return count


def _slot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    turned = hashing.mix(keys + np.uint64(((level + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    return (turned % np.uint64(bits)).astype(np.int64)


def build_levels(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels of a minimal perfect hash of distinct ``keys``, and all their bits."""
    sizes, parts, left = [], [], keys
    while len(left):
        bits = max(int(GAMMA * len(left)), 64)
        at = _slot(left, len(sizes), bits)
        counts = np.bincount(at, minlength=bits)
        parts.append(counts == 1)
        sizes.append(bits)
        left = left[counts[at] > 1]
    return sizes, np.concatenate(parts) if parts else np.zeros(0, bool)


def numbers_of(keys: np.ndarray, sizes: list[int], bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The number of each key, -1 where no level takes it; an unknown key may get any number."""
    found = np.full(len(keys), -1, np.int64)
    left, base = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = base + _slot(keys[left], level, size)
        hit = bits[at]
        found[left[hit]] = ranks[at[hit]]
        left, base = left[~hit], base + size
    return found


SHARDS = "shard int, levels binary, bits binary, fingerprints binary, counts binary"


def _shard(table: pa.Table) -> pa.Table:
    one, other = (table[c].to_numpy().view(np.uint64) for c in ("one", "other"))
    # Keys are told apart by both hashes; the levels see them mixed into one.
    keys = hashing.mix(one) ^ other
    n = table["n"].to_numpy()
    sizes, bits = build_levels(keys)
    number = numbers_of(keys, sizes, bits, np.cumsum(bits) - 1)
    prints, counts = np.empty(len(keys), np.uint64), np.empty(len(keys), np.uint32)
    prints[number] = one
    counts[number] = np.minimum(n, 2**32 - 1)
    return pa.table({
        "shard": table["shard"].slice(0, 1),
        "levels": pa.array([np.array(sizes, np.int64).tobytes()], pa.binary()),
        "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
        "fingerprints": pa.array([prints.tobytes()], pa.binary()),
        "counts": pa.array([counts.tobytes()], pa.binary()),
    })


def build_index(
    docs: DataFrame, text: str, folder: str, min_documents: int = MIN_DOCUMENTS,
    min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS,
) -> tuple[DataFrame, int]:
    """The shards as a stored table, and their number. Keys below the limit are not indexed:
    no document needs them."""
    counted = docs.select(F.col(text).alias("text")).mapInArrow(
        count_batches(min_chars), "one long, other long, n long"
    )
    frequent = stored(
        counted.groupBy("one", "other").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_documents),
        folder, "frequent",
    )
    shards = max(1, -(-frequent.count() // shard_keys))
    dealt = frequent.withColumn("shard", _shard_of(F.col("one"), shards))
    return stored(dealt.groupBy("shard").applyInArrow(_shard, SHARDS), folder, "index"), shards


def _shard_of(one, shards: int):
    """Shard of a hash, as :class:`Index` computes it as well."""
    return F.pmod(F.shiftrightunsigned(one, 8), F.lit(shards).cast("long")).cast("int")


class Index:
    """Shards in memory; ``probe`` gives the number of documents of each key, 0 if unknown."""

    def __init__(self, rows: list, shards: int):
        self._shards = shards
        self._parts = {}
        for row in rows:
            sizes = np.frombuffer(row["levels"], np.int64).tolist()
            bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
            self._parts[row["shard"]] = (
                sizes, bits, (np.cumsum(bits) - 1).astype(np.int32),
                np.frombuffer(row["fingerprints"], np.uint64), np.frombuffer(row["counts"], np.uint32),
            )

    def probe(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        out = np.zeros(len(one), np.int64)
        shard = ((one >> np.uint64(8)) % np.uint64(self._shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self._shards + 1))
        for number in self._parts:
            mine = order[edges[number] : edges[number + 1]]
            if len(mine):
                sizes, bits, ranks, prints, counts = self._parts[number]
                at = numbers_of(hashing.mix(one[mine]) ^ other[mine], sizes, bits, ranks)
                known = at >= 0
                known[known] = prints[at[known]] == one[mine[known]]
                out[mine[known]] = counts[at[known]]
        return out


def _kept(part: np.ndarray, begins, ends, drop: np.ndarray) -> bytes:
    """Lines that stay, joined by feeds."""
    raw = part.tobytes()
    return b"\n".join(raw[b:e] for b, e in zip(begins[~drop].tolist(), ends[~drop].tolist()))


def _cleaned(batch: pa.RecordBatch, drops: list[np.ndarray], schema: T.StructType) -> pa.RecordBatch:
    """The batch's rows with their text cleaned; ``drops`` marks lines, per chunk."""
    n_lines, n_dropped, texts = [], [], []
    for (lo, hi, part, begins, ends, rows, *_), drop in zip(lines_of(batch.column("text")), drops):
        edges = np.searchsorted(rows, np.arange(hi - lo + 1))
        total = np.concatenate([[0], np.cumsum(drop)])
        n_lines += np.diff(edges).tolist()
        n_dropped += np.diff(total[edges]).tolist()
        texts += [
            _kept(part, begins[a:b], ends[a:b], drop[a:b]) for a, b in zip(edges[:-1], edges[1:])
        ]
    names = [f.name for f in schema.fields[:-3]]
    return pa.RecordBatch.from_arrays(
        [batch.column(c) for c in names]
        + [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
        schema.names,
    )


def drop_frequent_lines(
    docs: DataFrame, text: str = "text", min_documents: int = MIN_DOCUMENTS,
    min_chars: int = MIN_CHARS, folder: str | None = None, max_index_bytes: int = MAX_INDEX_BYTES,
) -> DataFrame:
    """doc_id, n_lines, n_dropped, text: the documents without lines that stand in
    ``min_documents`` documents or more.

    A row is a document, repeated rows too; NULL counts as empty and is one empty line.
    Keys shorter than ``min_chars`` code points are never dropped. Where all lines go
    the text is empty. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    own, folder = folder is None, folder or run_folder(spark, "line-dedup")
    given = docs.select("doc_id", F.col(text).alias("text"))
    index, shards = build_index(given, "text", folder, min_documents, min_chars)
    size = F.octet_length("bits") * 40 + F.octet_length("fingerprints") + F.octet_length("counts")
    sized = index.select("shard", size.alias("bytes")).collect()
    schema = T.StructType([
        given.schema["doc_id"], T.StructField("n_lines", T.LongType()),
        T.StructField("n_dropped", T.LongType()), T.StructField("text", T.StringType()),
    ])
    parts = _parts({r["shard"]: r["bytes"] for r in sized}, max_index_bytes)
    if len(parts) <= 1:
        shared = spark.sparkContext.broadcast(index.collect())
        if own:
            tidy(spark, folder)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Index(shared.value, shards)
            for batch in batches:
                drops = [
                    valid & (known.probe(one, other) > 0)
                    for *_, one, other, valid in lines_of(batch.column("text"), min_chars)
                ]
                yield _cleaned(batch, drops, schema)

        return given.mapInArrow(clean, schema)
    return _in_parts(given, index, parts, shards, min_chars, folder, schema)


def _parts(sizes: dict[int, int], most: int) -> list[list[int]]:
    """Shards in groups of at most ``most`` bytes together (one shard at least)."""
    groups, held = [], most + 1
    for shard in sorted(sizes):
        if held + sizes[shard] > most:
            groups.append([])
            held = 0
        groups[-1].append(shard)
        held += sizes[shard]
    return groups


def _in_parts(given, index, parts, shards, min_chars, folder, schema) -> DataFrame:
    """Probe a part of the index at a time; only lines found are kept beside their row."""
    spark = given.sparkSession
    staged = stored(given.withColumn("__row", F.monotonically_increasing_id()), folder, "staged")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("__row").to_numpy()
            for lo, hi, _, _, _, rows, one, other, valid in lines_of(batch.column("text"), min_chars):
                line = np.arange(len(rows)) - np.searchsorted(rows, rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[lo:hi][rows[valid]]), pa.array(line[valid]),
                     pa.array(one[valid].view(np.int64)), pa.array(other[valid].view(np.int64))],
                    ["__row", "line", "one", "other"],
                )

    keys = stored(
        staged.mapInArrow(hashes, "__row long, line long, one long, other long"), folder, "keys"
    )
    found = None
    for number, part in enumerate(parts):
        shared = spark.sparkContext.broadcast(index.filter(F.col("shard").isin(part)).collect())

        def probe(batches, shared=shared):
            known = Index(shared.value, shards)
            for batch in batches:
                one, other = (batch.column(c).to_numpy().view(np.uint64) for c in ("one", "other"))
                hit = pa.array(known.probe(one, other) > 0)
                yield batch.select(["__row", "line"]).filter(hit)

        hits = stored(keys.mapInArrow(probe, "__row long, line long"), folder, f"hits-{number}")
        found = hits if found is None else found.union(hits)
    dropped = stored(found.groupBy("__row").agg(F.collect_list("line").alias("lines")), folder, "dropped")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column("lines")
            drops = []
            for lo, hi, _, _, _, rows, *_ in lines_of(batch.column("text"), min_chars):
                edges = np.searchsorted(rows, np.arange(hi - lo))
                drop = np.zeros(len(rows), bool)
                for k, lines in enumerate(gone.slice(lo, hi - lo).to_pylist()):
                    drop[edges[k] + np.array(lines or [], np.int64)] = True
                drops.append(drop)
            yield _cleaned(batch, drops, schema)

    return staged.join(dropped, "__row", "left").mapInArrow(clean, schema)


def line_report(
    docs: DataFrame, text: str = "text", min_documents: int = MIN_DOCUMENTS,
    min_chars: int = MIN_CHARS, folder: str | None = None, max_index_bytes: int = MAX_INDEX_BYTES,
) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: one row per document."""
    cleaned = drop_frequent_lines(docs, text, min_documents, min_chars, folder, max_index_bytes)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
