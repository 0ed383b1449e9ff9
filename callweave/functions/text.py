"""Text expressions: segmentation, cleaning, accents, stop words."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from callweave.session import scratch
from callweave.sources.sinks import materialize

# Executors get the functions of this module with the job, not from an installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HAN = r"\x{4e00}-\x{9fa5}"
#: A run of word characters other than Han characters.
OTHER_WORD = rf"[\p{{L}}\p{{M}}\p{{N}}_&&[^{HAN}]]+"
#: Bound of a lexicon that is sent to the executors.
MAX_LEXICON_BYTES = 256 << 20
#: Pieces of texts whose tokens a worker keeps, and the longest one that is kept.
KEPT_PIECES, KEPT_LENGTH = 1 << 18, 64
#: Terms a term matrix counts: two word characters or more.
TERM = r"[\p{L}\p{N}_]{2,}"


def segmentation_pattern(words: Iterable[str]) -> str:
    """Pattern whose successive matches are the tokens of a text.

    Listed words first, longest first; then single Han characters; then runs of
    other word characters.
    """
    listed = sorted(set(words), key=lambda w: (-len(w), w))
    escaped = [re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", w) for w in listed]
    return "|".join([*escaped, f"[{HAN}]", OTHER_WORD])


def tokenize(
    df: DataFrame,
    column: str,
    words: Sequence[str] = (),
    dictionary: Iterable[str] | DataFrame | None = None,
    out: str = "tokens",
) -> DataFrame:
    """Split a text into words by greedy longest match; array column ``out``.

    ``words`` are forced words and part of one pattern, matched in the JVM.
    ``dictionary`` is for lexicons too large for a pattern: a list, or a table with the
    column ``word``. They are sent to the executors once, up to :data:`MAX_LEXICON_BYTES`,
    and matched in Arrow batches.
    """
    if dictionary is None:
        pattern = segmentation_pattern(words)
        return df.withColumn(out, F.regexp_extract_all(column, F.lit(pattern), F.lit(0)))
    lexicon = {*words, *_listed(dictionary)}
    size = sum(len(w.encode()) + 64 for w in lexicon)
    if size > MAX_LEXICON_BYTES:
        raise ValueError(f"a lexicon of about {size} bytes is above {MAX_LEXICON_BYTES}")
    return df.withColumn(out, _longest_match(df.sparkSession, lexicon)(F.col(column)))


def _listed(dictionary: Iterable[str] | DataFrame) -> Iterable[str]:
    """The words; of a table no more than the bound allows are read."""
    if not isinstance(dictionary, DataFrame):
        return dictionary
    with scratch(dictionary.sparkSession, "lexicon") as folder:
        # Stored: the table may come from all texts, and it is read twice.
        known = materialize(dictionary.select("word").filter("word <> ''").distinct(), folder)
        size = known.agg(F.sum(F.octet_length("word") + 64)).first()[0] or 0
        if size > MAX_LEXICON_BYTES:
            raise ValueError(f"a lexicon of about {size} bytes is above {MAX_LEXICON_BYTES}")
        return [r.word for r in known.collect()]


def _longest_match(spark, lexicon: set[str]):
    # By first character, with the lengths that occur there, longest first.
    lengths: dict[str, set[int]] = {}
    for word in lexicon:
        lengths.setdefault(word[0], set()).add(len(word))
    shared = spark.sparkContext.broadcast(
        (frozenset(lexicon), {c: sorted(n, reverse=True) for c, n in lengths.items()})
    )
    other = re.compile(r"[^\W一-龥]+")
    run_of_words = re.compile(r"\w+")
    # Then no word reaches beyond a run of word characters, and equal runs have equal tokens.
    apart = all(run_of_words.fullmatch(word) for word in lexicon)
    kept: dict[str, list[str]] = {}

    def longest(text: str) -> list[str]:
        known, sizes = shared.value
        tokens, at = [], 0
        while at < len(text):
            end = next(
                (at + n for n in sizes.get(text[at], ()) if text[at : at + n] in known), 0
            )
            if not end:
                run = other.match(text, at)
                if run:
                    end = run.end()
                elif "一" <= text[at] <= "龥":
                    end = at + 1
                else:
                    at += 1
                    continue
            tokens.append(text[at:end])
            at = end
        return tokens

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def segment(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        if not apart:
            return pa.array([None if r is None else longest(r) for r in rows], pa.list_(pa.string()))
        pieces = [None if r is None else run_of_words.findall(r) for r in rows]
        return tokens_of_pieces(pa.array(pieces, pa.list_(pa.string())), longest, kept)

    return segment


def tokens_of_pieces(
    pieces: pa.ListArray, cut: Callable[[str], list[str]], kept: dict[str, list[str]]
) -> pa.ListArray:
    """The tokens of rows of pieces. Equal pieces are looked up once, and ``cut`` if they are
    not among those ``kept`` from before; Arrow repeats their tokens."""
    coded = pieces.flatten().dictionary_encode()
    found = []
    for piece in coded.dictionary.to_pylist():
        own = kept.get(piece)
        if own is None:
            own = cut(piece)
            if len(piece) <= KEPT_LENGTH:
                if len(kept) >= KEPT_PIECES:
                    kept.clear()
                kept[piece] = own
        found.append(own)
    taken = pa.array(found, pa.list_(pa.string())).take(coded.indices)
    ends = np.cumsum(np.append(0, taken.value_lengths().to_numpy(zero_copy_only=False)))
    rows = np.cumsum(np.append(0, pieces.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    return pa.ListArray.from_arrays(
        pa.array(ends[rows], pa.int32()), taken.flatten(), mask=pieces.is_null()
    )


@lru_cache
def _accent_table() -> tuple[str, str, str, str, tuple[str, ...]]:
    """Characters with one base character, and those bases; a pattern for the characters that
    become several or other ones beyond that, these characters, and what they become.

    Follows from the Unicode compatibility decomposition of every code point; combining
    marks come last among the characters and have no counterpart, which deletes them.
    Hangul syllables are in the pattern only: their letters follow from their number.
    """
    source, target, marks, wide, bases, ranges = [], [], [], [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(char)
            continue
        parts = unicodedata.normalize("NFKD", char)
        base = "".join(c for c in parts if not unicodedata.combining(c))
        if base == char:
            continue
        if len(base) == 1:
            source.append(char)
            target.append(base)
            continue
        if not HANGUL <= code < HANGUL + 11172:
            wide.append(char)
            bases.append(base)
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    classes = "".join(f"\\x{{{first:x}}}-\\x{{{last:x}}}" for first, last in ranges)
    return "".join(source + marks), "".join(target), f"[{classes}]", "".join(wide), tuple(bases)


#: First Hangul syllable, and its first leading, medial and trailing letter.
HANGUL, LEADING, MEDIAL, TRAILING = 0xAC00, 0x1100, 0x1161, 0x11A7


def _several(char: Column) -> Column:
    """What a character of the pattern becomes."""
    _, _, _, wide, bases = _accent_table()
    # One folded literal: the place of the character is that of its letters.
    listed = F.element_at(F.split(F.lit("\x00".join(bases)), "\x00"), F.instr(F.lit(wide), char))
    # UTF-16 of the syllable's letters by their numbers.
    number = F.conv(F.hex(F.encode(char, "UTF-16BE")), 16, 10).cast("int") - HANGUL
    tail = number % 28
    letter = lambda n: F.unhex(F.lpad(F.hex(n), 4, "0"))
    syllable = F.decode(
        F.concat(
            letter(LEADING + F.floor(number / 588)), letter(MEDIAL + F.floor(number % 588 / 28)),
            F.when(tail > 0, letter(TRAILING + tail)).otherwise(F.unhex(F.lit(""))),
        ),
        "UTF-16BE",
    )
    return F.when(char.between(F.lit(chr(HANGUL)), F.lit(chr(HANGUL + 11171))), syllable).otherwise(listed)


def _put_together(text: Column, pattern: str, become) -> Column:
    """The text with every match of ``pattern`` replaced by ``become`` of it."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), become)
    pieces = F.zip_with(
        F.split(text, pattern, -1), found,
        lambda part, match: F.concat(part, F.coalesce(match, F.lit(""))),
    )
    return F.array_join(pieces, "")


def strip_accents(text: Column) -> Column:
    """Compatibility decomposition without combining marks, for any script.

    ASCII texts stay as they are, others take one table look-up per character. Only in texts
    with characters that become several (ligatures, fractions, squared units, Hangul) the
    runs beyond ASCII are looked at one by one: they are cut at these characters and put
    together again with their letters. All in the JVM.
    """
    source, target, pattern, wide, _ = _accent_table()
    wide += "".join(map(chr, range(HANGUL, HANGUL + 11172)))

    def plain(run: Column) -> Column:
        several = F.translate(_put_together(run, pattern, _several), source, target)
        return F.when(run.rlike(pattern), several).otherwise(F.translate(run, source, target))

    ascii_only = F.octet_length(text) == F.char_length(text)
    none_wide = F.char_length(F.translate(text, wide, "")) == F.char_length(text)
    return (
        F.when(ascii_only, text)
        .when(none_wide, F.translate(text, source, target))
        .otherwise(_put_together(text, r"[^\x00-\x7f]+", plain))
    )


@F.pandas_udf(T.StringType())
def strip_accents_full(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, for any script."""
    def strip(text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        parts = unicodedata.normalize("NFKD", text)
        return "".join(c for c in parts if not unicodedata.combining(c))

    return texts.map(strip)


def remove_stopwords(tokens: Column, stopwords: Sequence[str]) -> Column:
    """Tokens not in the list; order and repeats stay."""
    words = list(stopwords)
    return F.filter(tokens, lambda t: ~t.isin(words)) if words else tokens


def without_punctuation(text: Column) -> Column:
    """Lower case, ASCII punctuation removed."""
    return F.regexp_replace(F.lower(text), r"\p{Punct}", "")


def clean_english(
    df: DataFrame,
    column: str,
    stopwords: Sequence[str],
    lemmas: Mapping[str, str] | None = None,
    out: str = "tokens",
) -> DataFrame:
    """English words of a text, in the order lower, split, stop words, punctuation, lemma.

    Stop words go before punctuation, so one with a comma stays. ``lemmas`` maps
    forms to base forms and suits a short table; for a long one see
    :func:`lemmatize`.
    """
    words = F.split(F.trim(F.lower(column)), r"\s+")
    bare = F.regexp_replace(
        F.array_join(remove_stopwords(words, stopwords), " "), r"\p{Punct}", ""
    )
    tokens = F.filter(F.split(bare, r"\s+"), lambda t: t != "")
    if lemmas:
        table = F.create_map(*[F.lit(x) for pair in lemmas.items() for x in pair])
        tokens = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t))
    return df.withColumn(out, tokens)


def lemmatize(terms: DataFrame, lemmas: DataFrame, column: str = "term") -> DataFrame:
    """Replace forms by base forms from a table ``form, lemma``; others stay."""
    table = lemmas.select(F.col("form").alias(column), "lemma").dropDuplicates([column])
    return (
        terms.join(table, column, "left")
        .withColumn(column, F.coalesce("lemma", F.col(column)))
        .drop("lemma")
    )


def matrix_terms(text: Column) -> Column:
    """Terms of a text as a term matrix counts them: lower case, no accents, two
    word characters or more."""
    return F.regexp_extract_all(strip_accents(F.lower(text)), F.lit(TERM), F.lit(0))
