"""Token ids in files of independent rANS blocks.

All blocks share one static table of frequencies, counted over the whole corpus. The ids
of a block are dealt to interleaved lanes, each a range asymmetric numeral system coder
with a 64-bit state and 32-bit output words. At fixed steps the lanes' states and the place
in the words are kept as checkpoints, so parts of a block decode in parallel; checksums
cover the payload and the ids.

A payload is: magic, number of ids, lanes, steps between checkpoints, number of words,
crc32 of the ids and crc32 of what follows (little-endian 32-bit values); per checkpoint the
place in the words and the states; the words in the order of decoding.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from callweave.llm.common import run_folder, stored
from callweave.llm.tokens import tokenizer

END = 0
SCALE_BITS = 20
LANES = 1024
#: Steps between checkpoints: 131 072 ids.
CHECKPOINT_STEPS = 128
BLOCK_TOKENS = 1 << 18
FILE_TOKENS = 1 << 23
#: A table of one row per file is broadcast up to this many files, else joined by shuffle.
BROADCAST_FILES = 1 << 18
_MAGIC = 0x534E4152
_HEADER = struct.Struct("<7I")
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


class Table:
    """Frequencies scaled to 2**SCALE_BITS, at least 1 each, and the inverse lookup."""

    def __init__(self, counts: np.ndarray):
        n, scale = len(counts), 1 << SCALE_BITS
        if not 0 < n <= scale // 2:
            raise ValueError(f"a vocabulary of {n} ids does not fit the table")
        total = int(counts.sum())
        spare = scale - n
        scaled = (counts.astype(object) * spare // total).astype(np.int64) if total else np.zeros(n, np.int64)
        freq = scaled + 1
        freq[int(np.argmax(freq))] += scale - int(freq.sum())
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(n, dtype=np.uint32), freq)


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """One payload; any number of ids, also none."""
    n = len(ids)
    lanes = min(LANES, max(1, n // 64))
    steps = -(-n // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    written, marks = 0, []
    for step in range(steps - 1, -1, -1):
        symbols = ids[step * lanes : (step + 1) * lanes]
        x, f = state[: len(symbols)].copy(), table.freq[symbols]
        full = x >= f << np.uint64(63 - SCALE_BITS)
        out = x[full]
        words.append(out.astype("<u4"))
        written += len(out)
        x[full] = out >> _WORD
        high = x // f
        state[: len(symbols)] = (high << np.uint64(SCALE_BITS)) + (x - high * f) + table.start[symbols]
        if step % CHECKPOINT_STEPS == 0:
            marks.append((written, state.astype("<u8").tobytes()))
    body = b"".join(struct.pack("<I", written - at) + kept for at, kept in reversed(marks))
    body += b"".join(w.tobytes() for w in reversed(words))
    raw = zlib.crc32(ids.astype("<u4").tobytes())
    return _HEADER.pack(_MAGIC, n, lanes, CHECKPOINT_STEPS, written, raw, zlib.crc32(body)) + body


def decode_part(payload: bytes, table: Table, part: int) -> np.ndarray:
    """Ids from checkpoint ``part`` to the next; parts do not need each other."""
    _, n, lanes, every, count, _, _ = _HEADER.unpack_from(payload)
    steps = -(-n // lanes)
    size = 4 + 8 * lanes
    at = _HEADER.size + part * size
    (place,) = struct.unpack_from("<I", payload, at)
    state = np.frombuffer(payload, "<u8", lanes, at + 4).astype(np.uint64)
    words = np.frombuffer(payload, "<u4", count, _HEADER.size + -(-steps // every) * size)
    first, last = part * every, min((part + 1) * every, steps)
    out = np.zeros(min(last * lanes, n) - first * lanes, np.uint32)
    for step in range(first, last):
        begin = (step - first) * lanes
        k = min(lanes, len(out) - begin)
        x = state[:k]
        slot = x & np.uint64((1 << SCALE_BITS) - 1)
        symbols = table.symbol[slot]
        out[begin : begin + k] = symbols
        x = table.freq[symbols] * (x >> np.uint64(SCALE_BITS)) + slot - table.start[symbols]
        low = np.flatnonzero(x < _LOW)
        x[low] = (x[low] << _WORD) | words[place : place + len(low)]
        place += len(low)
        state[:k] = x
    return out


def decode_block(payload: bytes, table: Table) -> np.ndarray:
    """All ids of a payload, after its checksums have been tested."""
    magic, n, lanes, every, _, raw, body = _HEADER.unpack_from(payload)
    if magic != _MAGIC or zlib.crc32(payload[_HEADER.size :]) != body:
        raise ValueError("damaged block")
    parts = -(-(-(-n // lanes)) // every)
    found = [decode_part(payload, table, part) for part in range(parts)]
    ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != raw:
        raise ValueError("damaged ids")
    return ids


def token_table(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, tie, ids (little-endian, 2 bytes each where the vocabulary allows, else 4)."""
    kind = "<u2" if vocabulary_size(path) <= 1 << 16 else "<u4"
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("tie", T.LongType()), T.StructField("ids", T.BinaryType())
    ])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        for batch in batches:
            ids, offsets = encoder.encode(batch.column("text"))
            rows = [
                np.append(ids[offsets[k] : offsets[k + 1]], END).astype(kind).tobytes()
                for k in range(len(batch))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([zlib.crc32(r) for r in rows], pa.int64()),
                 pa.array(rows, pa.binary())],
                schema.names,
            )

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(encoded, schema)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def write(docs: DataFrame, path: str, target: str, text: str = "text", folder: str | None = None) -> None:
    """Write ``target``/blocks and ``target``/frequencies for all documents.

    Documents stand in ascending order of doc_id, NULL last; rows of one id in the order
    of their ids' checksum. Each range of ids is a file and is written by one task as a
    stream of blocks; a document is never split between blocks.
    """
    folder = folder or run_folder(docs.sparkSession, "token-ids")
    tokens = stored(token_table(docs, path, text), folder, "tokens")
    size = vocabulary_size(path)
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            data = b"".join(batch.column("ids").to_pylist())
            counts += np.bincount(np.frombuffer(data, kind), minlength=size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["id", "n"])

    frequencies = stored(
        tokens.select("ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")),
        target, "frequencies",
    )
    counts = read_counts(frequencies, size)
    files = max(1, -(-int(counts.sum()) // FILE_TOKENS))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    schema = T.StructType([
        T.StructField("file", T.IntegerType()), T.StructField("block", T.IntegerType()),
        T.StructField("before", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)),
        T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType()),
    ])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, file = Table(counts), TaskContext.get().partitionId()
        number, before, names, rows, held = 0, 0, [], [], 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(rows)
            columns = [
                pa.array([file], pa.int32()), pa.array([number], pa.int32()),
                pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([names]), pa.array([[len(r) for r in rows]], pa.list_(pa.int64())),
                pa.array([encode_block(ids, table)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            for name, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                names.append(name)
                rows.append(np.frombuffer(ids.as_buffer(), kind))
                held += len(rows[-1])
                if held >= BLOCK_TOKENS:
                    yield block()
                    number, before, names, rows, held = number + 1, before + held, [], [], 0
        if rows:
            yield block()

    (
        tokens.repartitionByRange(files, *order).sortWithinPartitions(*order)
        .mapInArrow(blocks, schema)
        .write.mode("overwrite").option("compression", "none").parquet(f"{target}/blocks")
    )


def read_counts(frequencies: DataFrame, size: int) -> np.ndarray:
    """Counts per id: at most one row per entry of the vocabulary reaches the driver."""
    counts = np.zeros(size, np.int64)
    for row in frequencies.collect():
        counts[row["id"]] = row["n"]
    return counts


def read(spark: SparkSession, target: str, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, decoded from the files."""
    counts = read_counts(spark.read.parquet(f"{target}/frequencies"), vocabulary_size(path))
    stored_blocks = spark.read.parquet(f"{target}/blocks")
    # One row per file, that is per FILE_TOKENS ids.
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = (
        stored_blocks.groupBy("file").agg(F.sum("n_tokens").alias("n"))
        .select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    )
    if stored_blocks.select("file").distinct().count() <= BROADCAST_FILES:
        files = F.broadcast(files)
    placed = stored_blocks.join(files, "file").select(
        (F.col("base") + F.col("before")).alias("start"), "doc_ids", "sizes", "payload"
    )
    schema = T.StructType([
        T.StructField("doc_id", stored_blocks.schema["doc_ids"].dataType.elementType),
        T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(counts)
        for batch in batches:
            for row in range(len(batch)):
                ids = decode_block(batch.column("payload")[row].as_py(), table).astype("<u4")
                sizes = np.array(batch.column("sizes")[row].as_py(), np.int64)
                ends = np.cumsum(sizes)
                sums = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, sizes)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[row].values,
                     pa.array(batch.column("start")[row].as_py() + ends - sizes),
                     pa.array(sizes), pa.array(sums, pa.int64())],
                    schema.names,
                )

    return placed.mapInArrow(decoded, schema)
