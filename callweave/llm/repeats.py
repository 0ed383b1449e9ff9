"""Removal of long byte strings that occur earlier in the corpus.

Texts are seen as one long string cut at document ends. Every ``LENGTH``-byte string holds
an anchor, the least hash of its ``GRAM``-byte strings, so equal strings have equal anchors
at equal places. Anchors are shuffled by their hash; an anchor whose whole surroundings
(all strings that hold it) stand elsewhere too is settled by a hash. Only anchors with
different surroundings are compared byte by byte: their suffixes are sorted, the common
prefixes of neighbours give the interval tree of an enhanced suffix array by one scan with
a stack, and inside each interval the same scan over what stands to the left tests the
left extensions. That gives every maximal repeat with all its occurrences; all but the
earliest are removed. Repeats around one anchor all hold it, so what they cover of an
occurrence is one range.

A string of LENGTH bytes reaches at least half of REACH beyond its anchor to one side.
Occurrences that share that much with no other, to neither side, are left out by a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from callweave.llm import bloom, exact_dedup, hashing
from callweave.llm.common import run_folder, stored, tidy

LENGTH = 100
GRAM = 32
#: Bytes that a string may reach beyond its anchor, to either side.
REACH = LENGTH - GRAM
#: Bytes that a string reaches at least to one of the sides.
HALF = REACH // 2
MAX_FILTER_BYTES = 64 << 20
_SETTLED = np.int64(-(2**63))


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) over each run of ``width`` values."""
    if len(values) < width:
        return values[:0]
    have = 1
    while 2 * have <= width:
        values = best(values[:-have], values[have:])
        have *= 2
    if have < width:
        values = best(values[: len(values) - (width - have)], values[width - have :])
    return values


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of all strings: text number, place, reach left and right, two hashes.

    The first hash is the anchor's own, the second that of all its surroundings. The last
    value holds a 32-bit hash of the HALF bytes to the left and one of those to the right,
    0 where the text ends before.
    """
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, k) for k in (np.int64,) * 4 + (np.uint64,) * 3)
    prefix = hashing.prefix_hashes(data)
    down = hashing._powers("down", hashing._INVERSE, n + 1)
    grams = hashing.mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1])
    least = _sliding(grams, REACH + 1, np.minimum)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    least[ends[: len(least)] - np.arange(len(least)) < LENGTH] = 0
    padded = np.zeros(len(least) + 2 * REACH, np.uint64)
    padded[REACH : REACH + len(least)] = least
    at = np.flatnonzero((grams == _sliding(padded, REACH + 1, np.maximum)) & (grams != 0))
    rows = np.searchsorted(offsets, at, "right") - 1
    left = np.minimum(REACH, at - offsets[rows])
    right = np.minimum(REACH, offsets[rows + 1] - at - GRAM)
    around = hashing.range_hashes(prefix, at - left, at + GRAM + right)
    around = hashing.mix(around + (left * (REACH + 1) + right).astype(np.uint64))
    low, one = np.uint64(0xFFFFFFFF), np.uint64(1)
    before = hashing.range_hashes(prefix, np.maximum(at - HALF, 0), at) & low | one
    after = hashing.range_hashes(prefix, at + GRAM, np.minimum(at + GRAM + HALF, n)) & low | one
    before[left < HALF] = 0
    after[right < HALF] = 0
    halves = before << np.uint64(32) | after
    return rows, at - offsets[rows], left, right, grams[at], around, halves


def _pack(place, left, right):
    return (place << 14 | left << 7 | right).astype(np.int64)


_ANCHOR_ROWS = "anchor long, around long, doc long, tag long, packed long, halves long"


def anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, tag, text -> anchors. Of those equal with all surroundings in a batch only the
    earliest goes on; the others are marked as settled."""
    for batch in batches:
        data, offsets = hashing.text_bytes(batch.column("text"))
        doc = batch.column("doc").to_numpy()
        tag = batch.column("tag").to_numpy()
        found: list[tuple[np.ndarray, ...]] = []
        for lo, hi in hashing.chunks(offsets):
            rows, place, left, right, own, around, halves = anchors(
                data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            )
            found.append((own, around, doc[lo:hi][rows], tag[lo:hi][rows], _pack(place, left, right), halves))
        if not found:
            continue
        own, around, docs, tags, packed, halves = (np.concatenate(c) for c in zip(*found))
        key = hashing.mix(own ^ hashing.mix(around))
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        several = same.copy()
        several[:-1] |= same[1:]
        again = order[several]
        if len(again):
            again = again[np.lexsort((packed[again], tags[again], docs[again], around[again], own[again]))]
            later = np.zeros(len(again), bool)
            later[1:] = (own[again][1:] == own[again][:-1]) & (around[again][1:] == around[again][:-1])
            packed[again[later]] |= _SETTLED
            # Any task will do for these.
            own[again[later]] = hashing.mix((packed[again[later]] ^ tags[again[later]]).view(np.uint64))
        for start in range(0, len(own), 1 << 17):
            part = slice(start, start + (1 << 17))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[part].view(np.int64)) for c in (own, around)]
                + [pa.array(docs[part]), pa.array(tags[part]), pa.array(packed[part]),
                   pa.array(halves[part].view(np.int64))],
                ["anchor", "around", "doc", "tag", "packed", "halves"],
            )


def settle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors sorted by anchor, around, doc, tag and place -> settled ones and open ones.

    Settled (open = false): an equal one with equal surroundings stands earlier. Open: the
    earliest of its surroundings, where the anchor has different ones.
    """
    def out(anchor, doc, tag, packed, is_open):
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (anchor, doc, tag, packed)] + [pa.array(np.full(len(doc), is_open))],
            ["anchor", "doc", "tag", "packed", "open"],
        )

    names = ("anchor", "around", "doc", "tag", "packed", "halves")
    tail: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in names]
        settled = columns[4] < 0
        if settled.any():
            yield out(columns[0][settled], *(c[settled] for c in columns[2:5]), False)
            columns = [c[~settled] for c in columns]
        if tail is not None:
            columns = [np.concatenate([t, c]) for t, c in zip(tail, columns)]
        if not len(columns[0]):
            continue
        anchor, around = columns[:2]
        later = np.zeros(len(anchor), bool)
        later[1:] = (anchor[1:] == anchor[:-1]) & (around[1:] == around[:-1])
        if later.any():
            yield out(anchor[later], *(c[later] for c in columns[2:5]), False)
            columns = [c[~later] for c in columns]
        # The last anchor may go on in the next batch.
        anchor = columns[0]
        cut = int(np.searchsorted(anchor, anchor[-1], "left"))
        tail = [c[cut:] for c in columns]
        yield from _open(*(c[:cut] for c in columns), out)
    if tail is not None:
        yield from _open(*tail, out)


def _open(anchor, _, doc, tag, packed, halves, out):
    """Those that share a half of their surroundings with another of the same anchor."""
    near = np.zeros(len(anchor), bool)
    for side in (halves.view(np.uint64) >> np.uint64(32), halves.view(np.uint64) & np.uint64(0xFFFFFFFF)):
        order = np.lexsort((side, anchor))
        own, side = anchor[order], side[order]
        same = (own[1:] == own[:-1]) & (side[1:] == side[:-1]) & (side[1:] != 0)
        near[order[1:][same]] = True
        near[order[:-1][same]] = True
    if near.any():
        yield out(anchor[near], doc[near], tag[near], packed[near], True)


def _runs(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Interval tree of sorted strings: (depth, first, last) with a depth of ``least`` or more.

    ``common[k]`` is the common prefix of strings k and k + 1. One scan with a stack.
    """
    stack: list[tuple[int, int]] = []
    for k, depth in enumerate([*common, -1]):
        first = k
        while stack and stack[-1][0] > depth:
            high, first = stack.pop()
            if high >= least:
                yield high, first, k
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def _common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if x[:mid] == y[:mid]:
            low = mid
        else:
            high = mid
    return low


def maximal_repeats(
    before: list[bytes], after: list[bytes]
) -> Iterator[tuple[int, int, list[int]]]:
    """(reach left, reach right, occurrences) of all maximal repeats around one anchor.

    ``before`` is what stands left of each occurrence, reversed. Right-diverse strings are
    the intervals of the sorted suffixes; among an interval's members the left-diverse ones
    are the intervals of what stands before them. Only repeats of LENGTH bytes or more.
    """
    if len(after) == 2:
        left, right = _common(*before), _common(*after)
        if left + right >= REACH:
            yield left, right, [0, 1]
        return
    order = sorted(range(len(after)), key=after.__getitem__)
    common = [_common(after[a], after[b]) for a, b in zip(order, order[1:])]
    for right, first, last in _runs(common, 0):
        members = sorted(order[first : last + 1], key=before.__getitem__)
        shared = [_common(before[a], before[b]) for a, b in zip(members, members[1:])]
        for left, begin, end in _runs(shared, REACH - right):
            yield left, right, members[begin : end + 1]


def repeat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences sorted by anchor (anchor, doc, tag, place, before, after) -> covered ranges."""
    held: list[tuple] = []
    rows: list[tuple[int, int, int, int]] = []

    def group():
        held.sort(key=lambda r: r[1:4])
        reach = [[-1, -1] for _ in held]
        for left, right, members in maximal_repeats([r[4] for r in held], [r[5] for r in held]):
            first = min(members)
            for k in members:
                if k != first:
                    own = reach[k]
                    if left > own[0]:
                        own[0] = left
                    if right > own[1]:
                        own[1] = right
        for (_, doc, tag, place, _, _), (left, right) in zip(held, reach):
            if right >= 0:
                rows.append((doc, tag, place - left, place + GRAM + right))

    def flush():
        columns = list(zip(*rows))
        rows.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["doc", "tag", "begin", "end"]
        )

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("anchor", "doc", "tag", "place", "before", "after")]):
            if held and held[0][0] != row[0]:
                group()
                held = []
            held.append(row)
        if rows:
            yield flush()
    if held:
        group()
    if rows:
        yield flush()


def _near(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts that a bounded filter does not exclude from ``wanted`` (doc, tag)."""
    keys = wanted.select(F.xxhash64("doc", "tag").alias("__key"))
    blocks = bloom.blocks_for(wanted.count(), MAX_FILTER_BYTES)
    return bloom.probe(
        texts.withColumn("__key", F.xxhash64("doc", "tag")), "__key",
        bloom.build(keys, "__key", blocks), blocks, "__maybe",
    ).filter("__maybe").drop("__key", "__maybe")


def context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, tag, text, places -> anchor, doc, tag, place, before (reversed), after."""
    for batch in batches:
        rows = []
        for doc, tag, text, wanted in zip(*[batch.column(c).to_pylist() for c in ("doc", "tag", "text", "wanted")]):
            data = text.encode()
            for w in wanted:
                at = w["place"]
                rows.append((w["anchor"], doc, tag, at, data[max(0, at - REACH) : at][::-1],
                             data[at + GRAM : at + GRAM + REACH]))
        kinds = [pa.int64()] * 4 + [pa.binary()] * 2
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds],
            ["anchor", "doc", "tag", "place", "before", "after"],
        )


def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, ranges -> text_sha256, n_removed, n_spans, kept_sha256."""
    for batch in batches:
        rows = []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
            data = text.encode()
            spans: list[list[int]] = []
            for r in sorted((r["begin"], r["end"]) for r in ranges):
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append(list(r))
            edges = [0, *(e for s in spans for e in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rows.append((hashlib.sha256(data).digest(), len(data) - len(kept), len(spans),
                         hashlib.sha256(kept).hexdigest()))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds],
            ["node", "n_removed", "n_spans", "kept_sha256"],
        )


def covered_ranges(texts: DataFrame, folder: str) -> DataFrame:
    """doc, tag, begin, end: ranges of texts (doc, tag, text) that occur earlier."""
    found = stored(
        texts.mapInArrow(anchor_batches, _ANCHOR_ROWS)
        .repartition(F.col("anchor"))
        .sortWithinPartitions("anchor", "around", "doc", "tag", "packed")
        .mapInArrow(settle_batches, "anchor long, doc long, tag long, packed long, open boolean"),
        folder, "anchors",
    )
    rest = F.col("packed").bitwiseAND(F.lit(2**63 - 1))
    seen = found.select(
        "anchor", "doc", "tag", "open",
        F.shiftright(rest, 14).alias("place"),
        F.shiftright(rest, 7).bitwiseAND(F.lit(127)).alias("left"),
        rest.bitwiseAND(F.lit(127)).alias("right"),
    )
    settled = seen.filter("not open").select(
        "doc", "tag", (F.col("place") - F.col("left")).alias("begin"),
        (F.col("place") + GRAM + F.col("right")).alias("end"),
    )
    wanted = stored(
        seen.filter("open").groupBy("doc", "tag")
        .agg(F.collect_list(F.struct("anchor", "place")).alias("wanted")),
        folder, "wanted",
    )
    contexts = (
        _near(texts, wanted.select("doc", "tag")).join(wanted, ["doc", "tag"])
        .select("doc", "tag", "text", "wanted")
        .mapInArrow(context_batches, "anchor long, doc long, tag long, place long, before binary, after binary")
    )
    compared = (
        contexts.repartition(F.col("anchor")).sortWithinPartitions("anchor")
        .mapInArrow(repeat_batches, "doc long, tag long, begin long, end long")
    )
    return stored(settled.unionByName(compared), folder, "ranges")


def repeat_report(docs: DataFrame, text: str = "text", folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row per document.

    NULL is empty. Rows with a NULL id come last, rows of one id in the order of their
    text's hash; rows equal in id and text are one document and share their result.
    """
    given_folder, folder = folder, folder or run_folder(docs.sparkSession, "repeats")
    value = F.coalesce(F.col(text), F.lit(""))
    given = docs.select("doc_id", value.alias("text"))
    rows = stored(
        given.select("doc_id", F.unhex(F.sha2("text", 256)).alias("node"),
                     F.octet_length("text").cast("long").alias("n_bytes")),
        folder, "rows",
    )
    single = exact_dedup.keep_one(given, folder=folder, largest=False)
    # Texts of one id are told apart, and ordered, by 62 bits of their hash; those without
    # an id come after every id.
    texts = single.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"),
        (F.shiftrightunsigned(F.xxhash64("text"), 2)
         + F.when(F.col("doc_id").isNull(), 2**62).otherwise(0)).alias("tag"), "text",
    ).filter(F.octet_length("text") >= LENGTH)
    ranges = stored(
        covered_ranges(texts, folder).groupBy("doc", "tag")
        .agg(F.collect_list(F.struct("begin", "end")).alias("ranges")),
        folder, "merged",
    )
    cut = stored(
        _near(texts, ranges.select("doc", "tag")).join(ranges, ["doc", "tag"])
        .select("text", "ranges")
        .mapInArrow(cut_batches, "node binary, n_removed long, n_spans long, kept_sha256 string"),
        folder, "cut",
    )
    repeated = stored(
        rows.groupBy("node").agg(
            F.count("*").alias("n"),
            F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"))).getField("doc_id").alias("first"),
        ).filter("n > 1").select("node", "first"),
        folder, "copies",
    )
    if given_folder is None:
        tidy(docs.sparkSession, folder, "rows", "cut", "copies")
    copy = F.col("first").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first"))
    whole = copy & (F.col("n_bytes") >= LENGTH)
    zero = F.lit(0).cast("long")
    return (
        rows.join(repeated, "node", "left").join(cut, "node", "left")
        .select(
            "doc_id", "n_bytes",
            F.when(whole, F.col("n_bytes")).when(copy, zero)
            .otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
            F.when(whole, F.lit(1).cast("long")).when(copy, zero)
            .otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
            F.when(whole, F.lit(hashlib.sha256(b"").hexdigest()))
            .otherwise(F.coalesce("kept_sha256", F.lower(F.hex("node")))).alias("kept_sha256"),
        )
    )
