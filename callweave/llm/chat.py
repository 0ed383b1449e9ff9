"""Chat formatting over a prefix tree of turns.

Conversations with the same first turns share them: sorted by the hashes of their turns,
they are a depth-first walk of the tree, cut into blocks of bounded size. In a block each
shared turn's tokens stand once. A token's position id counts from its conversation's
start, and a turn attends to the intervals of its ancestors and to itself.

A turn is written ``### role: text</turn>`` and a line feed; control strings inside are
escaped by a backslash. Only an assistant's text is under the loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from callweave.llm.common import run_folder, stored
from callweave.session import wide_rows

BLOCK_CONVERSATIONS = 1024
BLOCK_TOKENS = 1 << 18
TRAINED = "assistant"

_CONTROL = re.compile(r"\\|###|</turn>")
_CONTROL_ROLE = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*)</turn>\n", re.DOTALL)


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text, the text, what stands after it."""
    return f"### {escape(role, _CONTROL_ROLE)}: ", escape(text), "</turn>\n"


def parse_turn(formatted: str) -> tuple[str, str]:
    match = _TURN.fullmatch(formatted)
    if match is None:
        raise ValueError("not a formatted turn")
    return unescape(match[1]), unescape(match[2])


BLOCKS = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("positions", T.ArrayType(T.IntegerType())),
    T.StructField("loss", T.ArrayType(T.BooleanType())),
    T.StructField("attention", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("turn_begins", T.ArrayType(T.IntegerType())),
    T.StructField("conv_ids", T.ArrayType(T.LongType())),
    T.StructField("last_turns", T.ArrayType(T.IntegerType())),
])


class _Block:
    """Turns of a block in depth-first order; attention intervals are pairs in a row."""

    def __init__(self):
        self.ids: list[int] = []
        self.positions: list[int] = []
        self.loss: list[bool] = []
        self.attention: list[list[int]] = []
        self.begins: list[int] = []
        self.conv_ids: list = []
        self.last: list[int] = []
        self.path: list[tuple[bytes, int]] = []

    def add(self, conv_id, keys: list[bytes], turns: list, encode=lambda parts: parts) -> None:
        """``encode`` gives a turn's parts (under the loss mask, ids); shared turns are not encoded."""
        shared = 0
        while shared < min(len(keys), len(self.path)) and keys[shared] == self.path[shared][0]:
            shared += 1
        del self.path[shared:]
        for key, turn in zip(keys[shared:], turns[shared:]):
            parts = encode(turn)
            parent = self.path[-1][1] if self.path else None
            intervals = list(self.attention[parent]) if parent is not None else []
            begin = len(self.ids)
            start = self.positions[intervals[-1] - 1] + 1 if intervals else 0
            for trained, ids in parts:
                self.ids += ids
                self.loss += [trained] * len(ids)
            self.positions += range(start, start + len(self.ids) - begin)
            if intervals and intervals[-1] == begin:
                intervals[-1] = len(self.ids)
            else:
                intervals += [begin, len(self.ids)]
            self.attention.append(intervals)
            self.begins.append(begin)
            self.path.append((key, len(self.begins) - 1))
        self.conv_ids.append(conv_id)
        self.last.append(self.path[-1][1])

    def batch(self) -> pa.RecordBatch:
        values = [self.ids, self.positions, self.loss, self.attention, self.begins, self.conv_ids, self.last]
        kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()),
                 pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], BLOCKS.names)


def _encoder(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


def build_blocks(conversations: DataFrame, path: str) -> DataFrame:
    """One row per block of the prefix tree, columns as in :data:`BLOCKS`.

    Turns of a conversation are ordered by turn (NULL last), role and text; NULL roles and
    texts are empty. Rows without a conv_id are one conversation. A conversation is one
    sequence and so one value; no other group is gathered: equal conversations differ in the
    range key by their ids and are dealt over tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(
        F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"),
        role.alias("role"), text.alias("text"),
    )
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    keyed = whole.select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
    ).withColumn(
        "path",
        F.transform("turns", lambda t: F.substring(F.md5(F.concat(
            F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]).cast("binary")), 1, 16)),
    )
    order = [F.col("path"), F.col("conv_id").asc_nulls_last()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block = _encoder(path), _Block()

        def ids(value: str) -> list[int]:
            return encoder.encode(value, add_special_tokens=False).ids

        # The same few roles in all turns.
        frame_ids = lru_cache(1024)(ids)

        def parts(turn: dict) -> list[tuple[bool, list[int]]]:
            head, body, tail = format_turn(turn["role"], turn["text"])
            return [(False, frame_ids(head)), (turn["role"] == TRAINED, ids(body)), (False, frame_ids(tail))]

        for batch in batches:
            for k in range(len(batch)):
                conv_id, keys, turns = (batch.column(c)[k].as_py() for c in ("conv_id", "path", "turns"))
                if len(block.conv_ids) >= BLOCK_CONVERSATIONS or len(block.ids) >= BLOCK_TOKENS:
                    yield block.batch()
                    block = _Block()
                block.add(conv_id, keys, turns, parts)
        if block.conv_ids:
            yield block.batch()

    return (
        keyed.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv_id", "path", "turns").mapInArrow(walk, BLOCKS)
    )


def read_back(blocks: DataFrame, path: str) -> DataFrame:
    """Digests per conversation, read from the tokens that its last turn attends to."""
    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long"
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _encoder(path)
        for batch in batches:
            for k in range(len(batch)):
                yield _digest({name: batch.column(name)[k].values for name in BLOCKS.names}, decoder)

    return blocks.mapInArrow(digests, schema)


def _digest(row: dict, decoder) -> pa.RecordBatch:
    """``row``: a block's columns as Arrow arrays."""
    ids = row["ids"].to_numpy()
    trained = row["loss"].to_numpy(zero_copy_only=False).astype(bool)
    begins = row["turn_begins"].to_pylist()
    ends = begins[1:] + [len(ids)]
    turn_at = {begin: k for k, begin in enumerate(begins)}
    known: dict[int, tuple[str, str, str, int]] = {}

    def turn(k: int) -> tuple[str, str, str, int]:
        if k not in known:
            own, on = ids[begins[k] : ends[k]], trained[begins[k] : ends[k]]
            formatted = decoder.decode(own.tolist(), skip_special_tokens=False)
            masked = unescape(decoder.decode(own[on].tolist(), skip_special_tokens=False)) if on.any() else ""
            known[k] = (*parse_turn(formatted), masked, len(formatted))
        return known[k]

    out = []
    for conv_id, last in zip(row["conv_ids"].to_pylist(), row["last_turns"].to_pylist()):
        seen = row["attention"][last].as_py()
        own = []
        for begin, end in zip(seen[::2], seen[1::2]):
            while begin < end:
                own.append(turn_at[begin])
                begin = ends[own[-1]]
        turns = [turn(k) for k in own]
        loss = "".join(t[2] for t in turns)
        said = "".join(f"{t[0]}\n{t[1]}\n" for t in turns)
        out.append((
            conv_id, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest(), sum(t[3] for t in turns),
        ))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)


def chat_report(conversations: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Write the blocks and return what a reader finds in them, one row per conversation.

    A block is a row of some MB: they are read few at a time, and what is found is written, as
    that holds for reading done here only.
    """
    spark = conversations.sparkSession
    folder = folder or run_folder(spark, "chat")
    blocks = stored(build_blocks(conversations, path), folder, "blocks")
    with wide_rows(spark, BLOCK_CONVERSATIONS):
        return stored(read_back(blocks, path), folder, "report")
