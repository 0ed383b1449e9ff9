"""Near duplicates by ProbMinHash, banding and verification.

The similarity is the probability Jaccard of word shingles weighted by their number of
occurrences. Each shingle is a Poisson process whose rate is its weight and whose
arrivals hit random registers; a register keeps its earliest arrival, and a process
ends once its next arrival is later than all registers (early termination). A register
of two texts is equal with just that similarity, so bands of registers find candidates, and
the share of all registers that are equal estimates it. Texts with repeated shingles have
a second set of registers with all weights 1, equal with the Jaccard of the distinct
shingles; either similarity makes a near copy.

Buckets of texts with an equal band are not expanded into pairs. First leaders are compared
with all other members; the first leader of a bucket is the member that shares most buckets
with most texts, so the origin of a family gathers its copies at once. A bucket whose
members are then in one class is done. In any other, the members outside the largest class
are compared with all members, however many they are: a large bucket is dealt into pieces of
bounded size, so that every two of its members of different classes meet in one. Two texts that
share several such buckets are a pair of the first of them only.

Before any text is fetched a pair's registers are compared: pairs whose agreement is 2.5
deviations (with a leader 3.5) below the threshold go no further. The others are verified on whole texts,
dealt so that a text is sent and cut once for many of its pairs. Classes are connected components, found on distributed tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from callweave.llm import bloom, hashing
from callweave.llm.common import run_folder, stored, tidy

WIDTH = 5
SIMILARITY = 0.8
REGISTERS = 256
BANDS = 28
ROWS = 5
#: Bands whose buckets' sizes tell how wide a text reaches.
REACH_BANDS = 6
#: Equal registers from which on a pair is verified: the mean at the threshold less some deviations,
#: more of them for pairs with a leader, which are few, than for pairs inside a bucket.
DEVIATION = (SIMILARITY * (1 - SIMILARITY) * REGISTERS) ** 0.5
AGREEING_LED = int(SIMILARITY * REGISTERS - 3.5 * DEVIATION)
AGREEING = int(SIMILARITY * REGISTERS - 2.5 * DEVIATION)
#: Leaders of a bucket per round, before buckets are split.
LEADERS = (1, 4)
#: Buckets of a text, the largest known, whose first leaders it meets; the others follow if they
#: are still of several classes then.
FIRST_BUCKETS = 8
#: Members outside the largest class that are compared with all others, and rows of a piece.
FEW = 1024
PIECE = 2 * FEW
#: How often a bucket with many members outside its largest class is split before it is compared,
#: by so many further bands of so many registers. Every level loses pairs that agree in none of the
#: bands, so no bucket is split unless this is raised.
LEVELS = 0
SPLIT_BANDS = 3
SPLIT_ROWS = 4
MAX_FILTER_BYTES = 64 << 20
#: Texts of one bucket that are dealt together to be verified against such another lot.
LOT = 128


def signatures(
    rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, registers: int
) -> np.ndarray:
    """ProbMinHash registers of ``n`` texts; texts without shingles keep zeros."""
    times = np.full(n * registers, np.inf)
    owner = np.zeros(n * registers, np.uint64)
    base = rows * registers
    at = np.zeros(len(rows))
    arrival = 0
    while len(rows):
        arrival += 1
        drawn = hashing.mix(hashes + np.uint64((arrival * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        unit = ((drawn >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
        at = at - np.log(unit) / weights
        place = base + (hashing.mix(drawn) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(times, place, at)
        won = times[place] == at
        owner[place[won]] = hashes[won]
        latest = times.reshape(n, registers).max(axis=1)
        on = at < latest[rows]
        rows, hashes, weights, base, at = rows[on], hashes[on], weights[on], base[on], at[on]
    return owner.reshape(n, registers)


def _band_keys(signature: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    values = signature.reshape(len(signature), bands, per_band)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), values.shape[:2])
    for k in range(per_band):
        out = hashing.mix(out * np.uint64(0x9E3779B97F4A7C15) + values[:, :, k])
    return out.view(np.int64)


def sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, text -> node, bands (empty for texts without words), registers.

    Bands are those of the weighted shingles, then those of the distinct ones where they
    differ. Registers are a byte each, followed by the second set if there is one.
    """
    for batch in batches:
        data, offsets = hashing.text_bytes(batch.column("text"))
        bands, ends, registers = [], [0], []
        for lo, hi in hashing.chunks(offsets):
            begin = offsets[lo]
            own = offsets[lo : hi + 1] - begin
            words = hashing.word_hashes(data[begin : offsets[hi]], own)
            rows, hashes, counts = hashing.shingles(*words, WIDTH)
            one = signatures(rows, hashes, counts, hi - lo, REGISTERS)
            keys, short = _keys_of(one), hashing.mix(one).astype(np.uint8)
            # With weights of 1 all texts without repeats keep their registers.
            repeated = np.unique(rows[counts > 1])
            mine = np.isin(rows, repeated)
            two = signatures(
                np.searchsorted(repeated, rows[mine]), hashes[mine],
                np.ones(int(mine.sum()), counts.dtype), len(repeated), REGISTERS,
            )
            keys_two, short_two = _keys_of(two), hashing.mix(two).astype(np.uint8)
            worded = np.diff(words[1]) > 0
            at = {row: k for k, row in enumerate(repeated.tolist())}
            for row in range(hi - lo):
                k = at.get(row)
                if worded[row]:
                    bands.append(keys[row])
                    if k is not None:
                        bands.append(np.where(keys_two[k] != keys[row], keys_two[k], 0))
                ends.append(ends[-1] + BANDS * (int(worded[row]) + (k is not None)))
                registers.append(short[row].tobytes() + (short_two[k].tobytes() if k is not None else b""))
        flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        columns = [batch.column(c) for c in ("doc_id", "node")] + [lists, pa.array(registers, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "bands", "registers"])


def _keys_of(signature: np.ndarray) -> np.ndarray:
    return _band_keys(signature[:, : BANDS * ROWS], BANDS, ROWS)


def similarity(x: tuple, y: tuple) -> float:
    """The larger of the probability Jaccard and the Jaccard of the distinct shingles."""
    (hx, wx), (hy, wy) = x, y
    if not len(hx) or not len(hy):
        return float(len(hx) == len(hy))
    both, ix, iy = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    union = len(hx) + len(hy) - len(both)
    plain = len(both) / union
    if not len(both) or (wx.max() == 1 and wy.max() == 1):
        return plain
    # Sum over shared i of 1 / sum over all j of max(x_j / x_i, y_j / y_i): the terms j
    # with a ratio x_j / y_j above that of i count by x, all others by y.
    shared_x, shared_y = wx[ix].astype(float), wy[iy].astype(float)
    only_x, only_y = wx.sum() - shared_x.sum(), wy.sum() - shared_y.sum()
    ratio = shared_x / shared_y
    order = np.argsort(ratio, kind="stable")
    sorted_ratio = ratio[order]
    above_x = np.concatenate([np.cumsum(shared_x[order][::-1])[::-1], [0]])
    upto_y = np.concatenate([[0], np.cumsum(shared_y[order])])
    end = np.searchsorted(sorted_ratio, ratio, "right")
    total = (only_x + above_x[end]) / shared_x + (only_y + upto_y[end]) / shared_y
    return max(plain, float((1 / total).sum()))


def _shingle_sets(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    data, offsets = hashing.text_bytes(texts)
    found = []
    for lo, hi in hashing.chunks(offsets):
        words = hashing.word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        rows, hashes, counts = hashing.shingles(*words, WIDTH)
        cuts = np.searchsorted(rows, np.arange(1, hi - lo))
        found += zip(np.split(hashes, cuts), np.split(counts, cuts))
    return found


def verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and kind (key, kind, a, b, text) -> a, b, similarity.

    Of each key first come its texts (kind 0: node a), then its pairs (kind 1). A text is cut
    into shingles once per key.
    """
    key, held = None, {}
    for batch in batches:
        keys, kinds = (batch.column(c).to_numpy() for c in ("key", "kind"))
        edges = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1]))).tolist()
        one, two, values = [], [], []
        for lo, hi in zip(edges, [*edges[1:], len(batch)]):
            if keys[lo] != key:
                key, held = keys[lo], {}
            if not kinds[lo]:
                sets = _shingle_sets(batch.column("text").slice(lo, hi - lo))
                held.update(zip(batch.column("a").slice(lo, hi - lo).to_pylist(), sets))
                continue
            pairs = [batch.column(c).slice(lo, hi - lo).to_pylist() for c in "ab"]
            values += [similarity(held[x], held[y]) for x, y in zip(*pairs)]
            one += pairs[0]
            two += pairs[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(one, pa.binary()), pa.array(two, pa.binary()), pa.array(values, pa.float64())],
            ["a", "b", "similarity"],
        )


def _pair_keys(one: np.ndarray, two: np.ndarray) -> pa.Array:
    """One number for two lots, whichever comes first."""
    low, high = np.minimum(one, two).view(np.uint64), np.maximum(one, two).view(np.uint64)
    return pa.array(hashing.mix(hashing.mix(low) + high).view(np.int64))


def _bytes_of(column: pa.Array, width: int) -> np.ndarray:
    """A binary column whose values all have ``width`` bytes, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def agree_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b and their registers and lots -> a, b, key: the pairs that agree in enough registers."""
    for batch in batches:
        sets = []
        for c in "ab":
            values = batch.column(f"registers_{c}").to_pylist()
            sets.append([
                np.frombuffer(b"".join(v[k * REGISTERS : (k + 1) * REGISTERS] or v for v in values), np.uint8)
                .reshape(-1, REGISTERS) for k in (0, 1)
            ])
        near = np.zeros(len(batch), bool)
        for one, two in zip(*sets):
            near |= (one == two).sum(axis=1) >= AGREEING_LED
        key = _pair_keys(*(batch.column(f"lot_{c}").to_numpy() for c in "ab"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), key], ["a", "b", "key"]
        ).filter(pa.array(near))


def piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by piece (piece, bucket, node, label, lot, registers, own) -> pairs a, b, key of
    one piece and two classes that agree in enough registers.

    ``own`` are the buckets of the text that are compared, ascending; a pair is given in the
    first that both have.
    """
    def compare(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        piece, label, lot, bucket = (
            batch.column(c).to_numpy() for c in ("piece", "label", "lot", "bucket")
        )
        own = _padded(batch.column("own"))
        registers, node = _bytes_of(batch.column("registers"), REGISTERS), batch.column("node")
        step = 1
        while step < len(piece):
            same = piece[step:] == piece[:-step]
            if not same.any():
                return
            at = np.flatnonzero(same & (label[step:] != label[:-step]))
            at = at[(registers[at] == registers[at + step]).sum(axis=1) >= AGREEING]
            at = at[_first_shared(own, at, at + step) == bucket[at]]
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [node.take(pa.array(at)), node.take(pa.array(at + step)),
                     _pair_keys(lot[at], lot[at + step])],
                    ["a", "b", "key"],
                )
            step += 1

    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not len(batch):
            continue
        piece = batch.column("piece").to_numpy()
        # The last piece may go on in the next batch.
        cut = int(np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))[-1])
        held = batch.slice(cut)
        yield from compare(batch.slice(0, cut))
    if held is not None:
        yield from compare(held)


def _padded(lists: pa.Array) -> np.ndarray:
    """Lists of numbers as rows of one length, filled up with the least number."""
    sizes = lists.value_lengths().to_numpy()
    out = np.full((len(sizes), max(int(sizes.max(initial=0)), 1)), np.iinfo(np.int64).min)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _first_shared(own: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The least number that rows ``one`` and ``two`` have in common."""
    found = np.full(len(one), np.iinfo(np.int64).min)
    for lo in range(0, len(one), 256):
        part = slice(lo, lo + 256)
        a, b = own[one[part]], own[two[part]]
        both = (a[:, :, None] == b[:, None, :]).any(axis=2) & (a != np.iinfo(np.int64).min)
        found[part] = a[np.arange(len(a)), both.argmax(axis=1)]
    return found


def split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, node, label, ones, registers -> bucket, node, label, ones with the buckets of :data:`SPLIT_BANDS`
    further bands. A bucket's registers are drawn by its number, so its members agree on them."""
    for batch in batches:
        if not len(batch):
            continue
        bucket = batch.column("bucket").to_numpy().view(np.uint64)
        registers = _bytes_of(batch.column("registers"), REGISTERS)
        rows = np.arange(len(bucket))
        for band in range(SPLIT_BANDS):
            key = hashing.mix(bucket + np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            at, stride = key % np.uint64(REGISTERS), (key >> np.uint64(32)) | np.uint64(1)
            for _ in range(SPLIT_ROWS):
                value = registers[rows, at.astype(np.int64)].astype(np.uint64)
                key = hashing.mix(key * np.uint64(0x9E3779B97F4A7C15) + value)
                at = (at + stride) % np.uint64(REGISTERS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), *[batch.column(c) for c in ("node", "label", "ones")]],
                ["bucket", "node", "label", "ones"],
            )


def components(links: DataFrame, folder: str, name: str, steps: int | None = None) -> DataFrame:
    """node, root for every node of the links (a, b): the least node of its component.

    Alternates large-star and small-star steps until only stars are left; each step is a
    written table, so a lost executor costs a part of one step. With ``steps`` it ends
    after so many: nodes of one root are then in one component, but not the other way round.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    if steps is None:
        edges = stored(edges, folder, f"{name}-0")
    step = 0
    while step != steps:
        step += 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m")
        )
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(small_least, "u")
            .select(F.explode(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            )).alias("e")).select("e.*").filter("u <> v").distinct()
        )
        edges = stored(small, folder, f"{name}-{step}")
        # Stars: no root hangs on another node, and no node on two roots.
        roots = edges.select(F.col("v").alias("u"), F.lit(None).cast("binary").alias("v")).distinct()
        uneven = edges.union(roots).groupBy("u").agg(F.count("*").alias("n")).filter("n > 1")
        if steps is None and uneven.isEmpty():
            break
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
        .join(edges.select(F.col("u").alias("node")), "node", "left_anti")
    )


def _texts_of(docs: DataFrame, pairs: DataFrame, folder: str, name: str) -> DataFrame:
    """node, text of the nodes in stored pairs. A bounded filter keeps other texts from moving."""
    keys = pairs.select(F.xxhash64("a").alias("__key")).union(pairs.select(F.xxhash64("b")))
    blocks = bloom.blocks_for(2 * pairs.count(), MAX_FILTER_BYTES)
    near = bloom.probe(
        docs.withColumn("__key", F.xxhash64("node")), "__key",
        bloom.build(keys, "__key", blocks), blocks, "__maybe",
    )
    return stored(
        near.filter("__maybe").groupBy("node").agg(F.first("text").alias("text")), folder, name
    )


def _seats(known: DataFrame, labels: DataFrame | None) -> DataFrame:
    """bucket, node, ones, reach, label: a row per text and bucket."""
    nodes = known.select("node", "reach", "seats")
    if labels is None:
        nodes = nodes.withColumn("label", F.col("node"))
    else:
        nodes = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node"))
    return nodes.select("node", "reach", "label", F.explode("seats").alias("s")).select(
        "s.bucket", "node", "s.ones", "reach", "label"
    )


def _with_classes(seats: DataFrame) -> DataFrame:
    """The seats in buckets of two classes or more, with the bucket's members (n), its largest
    class, and how many are outside that class (others)."""
    sizes = seats.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = (
        sizes.groupBy("bucket").agg(
            F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most")
        )
        .select("bucket", "n", F.col("most.label").alias("largest"), (F.col("n") - F.col("most.n")).alias("others"))
        .filter("others > 0")
    )
    return seats.join(mixed, "bucket")


def _pair(one: str, other: str) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _beside(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs with the registers and lots of both their nodes."""
    for c in "ab":
        own = [F.col(name).alias(f"{name}_{c}") for name in ("registers", "lot")]
        pairs = pairs.join(known.select(F.col("node").alias(c), *own), c)
    return pairs


def _first_met(known: DataFrame) -> DataFrame:
    """Pairs of each text and the leaders of its largest buckets: of a bucket the member of the
    widest reach."""
    seats = _seats(known, None)
    best = F.max(F.struct("reach", F.xxhash64("bucket", "node"), "node")).alias("best")
    leaders = seats.groupBy("bucket").agg(best).select("bucket", F.col("best.node").alias("leader"))
    largest = F.slice(F.sort_array("seats", asc=False), 1, FIRST_BUCKETS)
    return (
        known.select("node", F.explode(largest).alias("s")).select(F.col("s.bucket").alias("bucket"), "node")
        .join(leaders, "bucket").filter("node <> leader").select(*_pair("node", "leader")).distinct()
    )


def _next_met(seats: DataFrame, leaders: int) -> DataFrame:
    """Pairs of a bucket's members and leaders drawn from outside its largest class, one per slot."""
    slot = F.pmod(F.xxhash64("node", "bucket"), F.lit(leaders))
    led = (
        seats.filter("label <> largest").groupBy("bucket", slot.alias("slot"))
        .agg(F.max(F.struct(F.xxhash64("bucket", "node").alias("h"), "node", "label")).alias("best"))
        .select("bucket", F.col("best.node").alias("leader"), F.col("best.label").alias("leader_label"))
    )
    return (
        seats.select("bucket", "node", "label").join(led, "bucket").filter("label <> leader_label")
        .select(*_pair("node", "leader")).distinct()
    )


def _pieces(seats: DataFrame, all_pairs: bool) -> DataFrame:
    """The seats with their ``piece``: every member outside a bucket's largest class meets every
    member of another class in a piece of about :data:`PIECE` rows.

    With ``all_pairs`` the others may be many: they are dealt in groups, and every two groups
    meet.
    """
    joined = seats.withColumn(
        "groups", F.ceil(F.col("others") / FEW) if all_pairs else F.lit(1).cast("long")
    )
    whole = F.col("n") <= PIECE
    chunks = F.when(whole, F.lit(1)).otherwise(F.ceil((F.col("n") - F.col("others")) / FEW)).cast("long")
    own = F.xxhash64("node")
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    group = F.pmod(own, F.col("groups"))
    places = F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))))
    # The largest class: its chunk beside every group. Others: their group beside every
    # chunk, and beside every other group.
    places = places.when(
        F.col("label") == F.col("largest"),
        F.transform(every(F.col("groups")), lambda g: F.struct(g.alias("x"), F.pmod(own, chunks).alias("y"))),
    ).otherwise(F.concat(
        F.transform(every(chunks), lambda c: F.struct(group.alias("x"), c.alias("y"))),
        F.transform(every(F.col("groups")), lambda g: F.struct(
            F.least(group, g).alias("x"), (-1 - F.greatest(group, g)).alias("y"))),
    ))
    return joined.withColumn("place", F.explode(places)).select(
        F.xxhash64("bucket", "place").alias("piece"), "bucket", "node",
        F.xxhash64("label").alias("label"), "lot", "registers", "own",
    )


def _own_registers() -> Column:
    """The set of registers that a seat's bucket is of."""
    return F.when(
        F.col("ones"), F.expr(f"substring(registers, {REGISTERS + 1}, {REGISTERS})")
    ).otherwise(F.expr(f"substring(registers, 1, {REGISTERS})")).alias("registers")


def _close_pairs(seats: DataFrame, known: DataFrame, folder: str) -> DataFrame:
    """Pairs of different classes in a common bucket that agree in enough registers.

    ``seats`` is a stored table of bucket, node, ones, label and the bucket's classes. All
    buckets are compared; with :data:`LEVELS` large ones only after so many splits.
    """
    found = None
    table = known.select("node", "lot", "registers")
    kept = ("bucket", "label", "n", "largest", "others", "node")
    for level in range(LEVELS + 1):
        last = level == LEVELS
        few = F.lit(True) if last else (F.col("others") <= FEW) | (F.col("n") <= PIECE)
        now = seats.filter(few)
        own = now.groupBy("node").agg(F.sort_array(F.collect_set("bucket")).alias("own"))
        rows = now.join(own.join(table, "node"), "node").select(*kept, "lot", _own_registers(), "own")
        close = stored(
            _pieces(rows, last).repartition("piece").sortWithinPartitions("piece")
            .mapInArrow(piece_batches, "a binary, b binary, key long").select(*_pair("a", "b"), "key").distinct(),
            folder, f"close-{level}",
        )
        found = close if found is None else found.union(close)
        large = seats.filter(~few)
        if last or large.isEmpty():
            return stored(found.distinct(), folder, "close") if level else found
        split = stored(
            large.join(table, "node").select("bucket", "node", "label", "ones", _own_registers())
            .mapInArrow(split_batches, "bucket long, node binary, label binary, ones boolean"),
            folder, f"split-{level}",
        )
        seats = stored(_with_classes(split), folder, f"level-{level + 1}")


def find_classes(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every row, and (node, root) of every node with a link.

    ``docs`` has doc_id, node and text; equal texts have equal nodes.
    """
    signed = stored(
        docs.mapInArrow(sign_batches, T.StructType([
            docs.schema["doc_id"], T.StructField("node", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("registers", T.BinaryType()),
        ])), folder, "signed",
    )
    nodes = stored(
        signed.groupBy("node").agg(F.first(F.struct("bands", "registers")).alias("s")).select("node", "s.*"),
        folder, "nodes",
    )
    placed = nodes.select("node", F.posexplode("bands").alias("place", "bucket")).filter("bucket <> 0")
    repeated = stored(
        placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), folder, "repeated"
    )
    # A bounded filter of the buckets with several members: no text's buckets are shuffled for it.
    blocks = bloom.blocks_for(repeated.count(), MAX_FILTER_BYTES)
    held = bloom.probe(placed, "bucket", bloom.build(repeated, "bucket", blocks), blocks, "__maybe").filter("__maybe")
    first = F.col("place") % BANDS < REACH_BANDS
    sized = held.filter(first).join(repeated, "bucket", "left").select("node", "place", "bucket", "n").union(
        held.filter(~first).select("node", "place", "bucket", F.lit(0).cast("long").alias("n"))
    )
    members = sized.groupBy("node").agg(
        F.sum(F.coalesce("n", F.lit(0))).alias("reach"),
        F.collect_list(F.struct("n", "bucket", (F.col("place") >= BANDS).alias("ones"))).alias("seats"),
    )
    # A text's lot: the texts that share its largest known bucket, dealt by hash.
    most = F.array_max("seats")
    lots = F.greatest(F.ceil(F.coalesce(most.getField("n"), F.lit(0)) / LOT), F.lit(1))
    lot = F.xxhash64(most.getField("bucket"), F.pmod(F.xxhash64("node"), lots))
    # Texts that may share a bucket with another one, with their buckets (at most 2 * BANDS).
    known = stored(
        members.join(nodes.select("node", "registers"), "node").withColumn("lot", lot), folder, "known"
    )
    links, labels = None, None
    for round_, leaders in enumerate(LEADERS):
        if not round_:
            pairs = _first_met(known)
        else:
            seats = stored(_with_classes(_seats(known, labels)), folder, f"seats-{round_}")
            wide = seats.filter((F.col("others") > FEW) & (F.col("n") > PIECE))
            if wide.isEmpty():
                break
            pairs = _next_met(wide, leaders)
        near = stored(
            _beside(stored(pairs, folder, f"met-{round_}"), known)
            .mapInArrow(agree_batches, "a binary, b binary, key long"),
            folder, f"near-{round_}",
        )
        new = _verified(near, docs, folder, f"round-{round_}")
        links = new if links is None else links.union(new)
        labels = stored(
            components(links, folder, f"stars-{round_}", steps=2), folder, f"labels-{round_}"
        )
    else:
        seats = stored(_with_classes(_seats(known, labels)), folder, "seats-last")
    rest = _close_pairs(seats, known, folder)
    links = links.union(_verified(rest, docs, folder, "rest"))
    return signed, stored(components(links, folder, "stars"), folder, "labels")


def _verified(pairs: DataFrame, docs: DataFrame, folder: str, name: str) -> DataFrame:
    """Links a, b among stored pairs (a, b, key), judged on whole texts.

    The texts of a key are sent to where its pairs are, each once.
    """
    texts = _texts_of(docs, pairs, folder, f"{name}-texts")
    nodes = pairs.select("key", F.col("a").alias("node")).union(pairs.select("key", "b")).distinct()
    wanted = nodes.join(texts, "node")
    rows = wanted.select(
        "key", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(None).cast("binary").alias("b"), "text"
    ).union(pairs.select("key", F.lit(1), "a", "b", F.lit(None).cast("string")))
    verified = stored(
        rows.repartition("key").sortWithinPartitions("key", "kind")
        .mapInArrow(verify_batches, "a binary, b binary, similarity double"),
        folder, name,
    )
    return verified.filter(F.col("similarity") >= SIMILARITY).select("a", "b")


def _noded(docs: DataFrame, text: str) -> DataFrame:
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.select("doc_id", F.unhex(F.md5(value.cast("binary"))).alias("node"), value.alias("text"))


def class_report(docs: DataFrame, text: str = "text", folder: str | None = None) -> DataFrame:
    """doc_id, class_id, class_size: one row per document.

    class_id is the least doc_id of the class (NULL ids last); a document without near
    copies is a class of its own. Equal texts are one class, also NULL and empty ones;
    texts of white space only have no shingles and match nothing but their equals.
    """
    own = folder or run_folder(docs.sparkSession, "near-dedup")
    signed, labels = find_classes(_noded(docs, text), own)
    if folder is None:
        tidy(docs.sparkSession, own, "signed", "labels")
    folder = own
    rows = signed.select("doc_id", "node").join(labels, "node", "left").select(
        "doc_id", F.coalesce("root", "node").alias("root")
    )
    # Stored, so that Spark can split a large class in the join.
    classes = stored(
        rows.groupBy("root").agg(
            F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")
        ),
        folder, "classes",
    )
    return rows.join(classes, "root").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, text: str = "text", folder: str | None = None) -> DataFrame:
    """The documents, one of each class, all columns as they were: the least doc_id stays.

    Documents that a bounded filter shows to be alone pass straight through.
    """
    own = folder or run_folder(docs.sparkSession, "near-dedup")
    signed, labels = find_classes(_noded(docs, text), own)
    if folder is None:
        tidy(docs.sparkSession, own, "signed", "labels")
    folder = own
    rows = signed.select("node").join(labels, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )
    shared = rows.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root")
    named = stored(
        rows.join(shared, "root").distinct(), folder, "shared"
    )
    order = ["doc_id"] + [
        f.name for f in docs.schema.fields
        if f.name not in ("doc_id", text) and isinstance(f.dataType, T.AtomicType)
    ]
    value = F.coalesce(F.col(text), F.lit(""))
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        F.struct(F.col("doc_id").isNull(), *[F.col(f"`{c}`") for c in order], F.md5(value.cast("binary"))).alias("__order"),
        F.unhex(F.md5(value.cast("binary"))).alias("node"),
    ).withColumn("__key", F.xxhash64("node"))
    keys = named.select(F.xxhash64("node").alias("__key"))
    blocks = bloom.blocks_for(named.count(), MAX_FILTER_BYTES)
    marked = bloom.probe(packed, "__key", bloom.build(keys, "__key", blocks), blocks, "__maybe")
    kept = (
        marked.filter("__maybe").join(named, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
        .groupBy("root").agg(F.min_by("__row", "__order").alias("__row"))
    )
    return marked.filter("not __maybe").select("__row").union(kept.select("__row")).select("__row.*")
