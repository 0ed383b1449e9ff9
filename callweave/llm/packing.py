"""Packing documents into sequences of a fixed number of tokens by best-two-fit.

A bin is filled greedily with the longest piece that fits. Then its smallest piece is
replaced by two unpacked pieces that together fill the widened gap more tightly, if there
are such. Only lengths are packed, in shards of bounded size, each in one task; a shard
leaves at most a few bins open.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from callweave.llm.common import run_folder, stored
from callweave.llm.tokens import tokenizer

CAPACITY = 2048
END = 0
#: Pieces packed by one task.
SHARD_PIECES = 32_768


def best_two_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins as lists of positions in ``lengths``; every length is 1 to ``capacity``.

    The lengths that are left are bits of one integer, so the longest that fits and two
    that add up to a sum are each found by one shift.
    """
    left: dict[int, list[int]] = {}
    for place in range(len(lengths) - 1, -1, -1):
        left.setdefault(lengths[place], []).append(place)
    have = sum(1 << n for n in left)
    mirrored = sum(1 << (capacity - n) for n in left)

    def take(n: int) -> int:
        nonlocal have, mirrored
        place = left[n].pop()
        if not left[n]:
            have ^= 1 << n
            mirrored ^= 1 << (capacity - n)
        return place

    def give(n: int, place: int) -> None:
        nonlocal have, mirrored
        left[n].append(place)
        have |= 1 << n
        mirrored |= 1 << (capacity - n)

    bins = []
    while have:
        gap, bin_ = capacity, []
        while fit := have & ((1 << (gap + 1)) - 1):
            n = fit.bit_length() - 1
            bin_.append(take(n))
            gap -= n
        smallest = lengths[bin_[-1]]
        room = gap + smallest
        if gap and have and room < capacity:
            for total in range(room, smallest, -1):
                pair = have & (mirrored >> (capacity - total))
                if not total % 2 and pair >> (total // 2) & 1 and len(left[total // 2]) < 2:
                    pair ^= 1 << (total // 2)
                if pair:
                    one = pair.bit_length() - 1
                    give(smallest, bin_.pop())
                    bin_ += [take(one), take(total - one)]
                    break
        bins.append(bin_)
    return bins


def pieces(docs: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 per piece of at most ``capacity`` tokens.

    A document is its ids, then the end id; NULL is empty. Longer ones are cut.
    """
    schema = docs.select("doc_id").schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")):
        schema = schema.add(name, kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        for batch in batches:
            ids, offsets = encoder.encode(batch.column("text"))
            rows, numbers, starts, sizes, sums = [], [], [], [], []
            for row in range(len(batch)):
                own = np.append(ids[offsets[row] : offsets[row + 1]], np.uint32(END)).astype("<u4")
                for number, start in enumerate(range(0, len(own), capacity)):
                    part = own[start : start + capacity]
                    rows.append(row)
                    numbers.append(number)
                    starts.append(start)
                    sizes.append(len(part))
                    sums.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())),
                 pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())],
                schema.names,
            )

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(cut, schema)


def pack(
    docs: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY,
    folder: str | None = None,
) -> DataFrame:
    """One row per piece with its sequence_id and its offset in the sequence.

    Full pieces are sequences of their own and are not shuffled. Repeated rows are
    packed like any others. An empty table has no sequences.
    """
    folder = folder or run_folder(docs.sparkSession, "packing")
    cut = stored(pieces(docs, path, text, capacity), folder, "pieces").withColumn(
        "__piece", F.monotonically_increasing_id()
    )
    full = cut.filter(F.col("length") == capacity).select(
        *cut.columns[:-1], (-F.col("__piece") - 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    rest = cut.filter(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // SHARD_PIECES))
    schema = full.schema

    def packed(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["__piece"].to_numpy(), -table["length"].to_numpy()))
        table = table.take(pa.array(order))
        lengths = table["length"].to_pylist()
        number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for bin_number, bin_ in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for place in bin_:
                number[place], offset[place] = bin_number, at
                at += lengths[place]
        shard = table["__shard"].to_numpy()
        columns = {name: table[name] for name in schema.names[:-2]}
        columns["sequence_id"] = pa.array(shard * (1 << 32) + number)
        columns["offset"] = pa.array(offset)
        return pa.table(columns)

    sharded = rest.withColumn("__shard", F.pmod(F.xxhash64("__piece"), F.lit(shards)).cast("long"))
    return full.unionByName(sharded.groupBy("__shard").applyInArrow(packed, schema))
