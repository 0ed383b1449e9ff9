"""Segmentation by the best path through a word lattice.

A text is cut at everything that is no word character, and at forced words, which stay
whole. In each piece all words of a lexicon are found at once by one prefix automaton;
they are the edges of a lattice over its characters, and the path with the greatest product
of word frequencies gives the tokens. Weights are logarithms in millionths, as whole
numbers, so sums are exact and equal paths are equal everywhere.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from callweave.functions.text import MAX_LEXICON_BYTES, tokens_of_pieces
from callweave.session import scratch
from callweave.sources.sinks import materialize

# Executors get the functions of this module with the job, not from an installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A run of word characters.
PIECE = r"[\p{L}\p{M}\p{N}_]+"
UNIT = 1_000_000


def weights(dictionary: Iterable[tuple[str, int]]) -> tuple[dict[str, int], int]:
    """Weight of each word, and of a token that the lexicon does not know.

    A word weighs the logarithm of its share of all counts, an unknown token as much as
    one that was counted once.
    """
    counts: dict[str, int] = {}
    for word, total in dictionary:
        if word and total > 0:
            counts[word] = counts.get(word, 0) + total
    whole = max(sum(counts.values()), 1)
    return (
        {word: round(UNIT * math.log(n / whole)) for word, n in counts.items()},
        round(UNIT * math.log(1 / whole)),
    )


class Lattice:
    """Best paths through texts. ``known`` are the weights of the lexicon's words."""

    def __init__(self, known: dict[str, int], unknown: int):
        import ahocorasick

        self._unknown = unknown
        self._found = ahocorasick.Automaton()
        for word, weight in known.items():
            self._found.add_word(word, (len(word), weight))
        if known:
            self._found.make_automaton()
        self._some = bool(known)

    def cut(self, text: str) -> list[str]:
        """Tokens of a run of word characters.

        Where no word of the lexicon begins, a Han character is a token, and so is the
        rest of a run of other characters; both may also stand for themselves where words
        begin. Of equally good paths the one whose first token is longer is taken, then
        whose second is, and so on.
        """
        n = len(text)
        edges: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        if self._some:
            for last, (size, weight) in self._found.iter(text):
                edges[last - size + 1].append((last + 1, weight))
        best, step, run_end = [0] * (n + 1), [0] * (n + 1), n
        for at in range(n - 1, -1, -1):
            if "一" <= text[at] <= "龥":
                run_end, end = at, at + 1
            else:
                end = run_end
            top, to = best[end] + self._unknown, end
            for end, weight in edges[at]:
                value = best[end] + weight
                if value > top or (value == top and end > to):
                    top, to = value, end
            best[at], step[at] = top, to
        tokens, at = [], 0
        while at < n:
            tokens.append(text[at : step[at]])
            at = step[at]
        return tokens


def segment(
    df: DataFrame, column: str, dictionary: Iterable[tuple[str, int]] | DataFrame,
    words: Sequence[str] = (), out: str = "tokens",
) -> DataFrame:
    """Split a text into words by the best path; array column ``out``.

    ``dictionary`` is a table with the columns ``word`` and ``total``, or such pairs. It is
    sent to the executors once, up to :data:`callweave.functions.text.MAX_LEXICON_BYTES`.
    ``words`` are forced words: their occurrences, the longest first, are tokens whatever
    the lexicon says. NULL texts have NULL tokens.
    """
    pairs = _pairs(dictionary)
    shared = df.sparkSession.sparkContext.broadcast(weights(pairs))
    forced = sorted(set(words) - {""}, key=lambda w: (-len(w), w))
    text = F.col(column)
    if forced:
        quoted = "|".join(_quoted(w) for w in forced)
        # Marks that are no word characters set forced words apart.
        text = F.regexp_replace(text, f"({quoted})", "\u0002$1\u0002")
        piece = f"\u0002(?:{quoted})\u0002|{PIECE}"
    else:
        piece = PIECE
    pieces = F.regexp_extract_all(text, F.lit(piece), F.lit(0))
    kept = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.StringType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        kept: dict[str, list[str]] = {}

        def tokens(piece: str) -> list[str]:
            return [piece.strip("\u0002")] if piece.startswith("\u0002") else lattice.cut(piece)

        for batch in batches:
            rows = tokens_of_pieces(batch.column(batch.num_columns - 1), tokens, kept)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], rows], schema.names)

    own = [F.col(f"`{f.name}`") for f in kept]
    return df.select(*own, pieces.alias("__pieces")).mapInArrow(cut, schema)


def _quoted(word: str) -> str:
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}-&" else c for c in word)


def _pairs(dictionary: Iterable[tuple[str, int]] | DataFrame) -> list[tuple[str, int]]:
    """The lexicon; of a table no more than the bound allows reaches the driver."""
    if isinstance(dictionary, DataFrame):
        known = (
            dictionary.filter("word <> '' and total > 0").groupBy("word")
            .agg(F.sum(F.col("total").cast("long")).alias("total"))
        )
        with scratch(dictionary.sparkSession, "lexicon") as folder:
            known = materialize(known, folder)
            size = known.agg(F.sum(F.octet_length("word") + 64)).first()[0] or 0
            if size > MAX_LEXICON_BYTES:
                raise ValueError(f"a lexicon of about {size} bytes is above {MAX_LEXICON_BYTES}")
            return [(r["word"], r["total"]) for r in known.collect()]
    pairs = list(dictionary)
    size = sum(len(w.encode()) + 64 for w, _ in pairs)
    if size > MAX_LEXICON_BYTES:
        raise ValueError(f"a lexicon of about {size} bytes is above {MAX_LEXICON_BYTES}")
    return pairs
