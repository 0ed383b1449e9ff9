"""A Bloom filter as a small table, built and probed with column functions.

The filter is cut into blocks of 512 words of 64 bits; a key sets and tests four bits
of one word, so a probe is one lookup in a broadcast table of at most ``max_bytes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORDS = 512
BITS_PER_KEY = 16


def _place(key: Column, blocks: int) -> tuple[Column, Column, Column]:
    """Block, word in the block and bit mask of a key."""
    mixed = F.xxhash64(key)
    mask = F.lit(0).cast("long")
    for probe in range(4):
        bit = F.shiftrightunsigned(mixed, 6 * probe).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    place = F.pmod(F.shiftrightunsigned(mixed, 24), F.lit(blocks * WORDS).cast("long"))
    return (place / WORDS).cast("long"), (place % WORDS).cast("int"), mask


def blocks_for(keys: int, max_bytes: int) -> int:
    """Blocks that give each key :data:`BITS_PER_KEY` bits, within ``max_bytes``.

    Beyond that the filter is denser: more rows pass it for nothing, none is missed.
    """
    wanted = -(-keys * BITS_PER_KEY // (64 * WORDS))
    return max(1, min(wanted, max_bytes // (8 * WORDS)))


def build(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter of all values of ``key``: one row per block."""
    block, word, mask = _place(F.col(key), blocks)
    ones = keys.select(block.alias("block"), word.alias("word"), mask.alias("bits"))
    zeros = keys.sparkSession.range(blocks * WORDS).select(
        (F.col("id") / WORDS).cast("long").alias("block"),
        (F.col("id") % WORDS).cast("int").alias("word"),
        F.lit(0).cast("long").alias("bits"),
    )
    words = ones.union(zeros).groupBy("block", "word").agg(F.bit_or("bits").alias("bits"))
    return words.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("word", "bits"))).getField("bits").alias("words")
    )


def probe(df: DataFrame, key: str, table: DataFrame, blocks: int, out: str) -> DataFrame:
    """Add ``out``: false only if the key is surely not in the filter. No row is shuffled."""
    block, word, mask = _place(F.col(key), blocks)
    filter_table = table.select(F.col("block").alias("__block"), F.col("words").alias("__words"))
    return (
        df.withColumn("__at", block)
        .join(F.broadcast(filter_table), F.col("__at") == F.col("__block"), "left")
        .withColumn(
            out,
            F.coalesce(F.get("__words", word).bitwiseAND(mask) == mask, F.lit(False)),
        )
        .drop("__at", "__block", "__words")
    )
