"""Language identification by compression.

Each language has a raw-content dictionary for zstandard, made of sample texts. A text is
compressed with every dictionary; the one that gives the fewest bytes wins. A narrow margin
to the second is rejected.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window, functions as F

from callweave.llm.common import fold

#: Bounds of the sample: texts per language, characters of a text, bytes of a dictionary.
SAMPLE_TEXTS = 96
#: Languages that are learned, the most frequent ones: a dictionary for each is in every worker.
MAX_LANGUAGES = 256
SAMPLE_CHARS = (40, 4000)
DICTIONARY_BYTES = 112 << 10
#: Slices of a text too long for the sample; texts too short for it that count as one.
SLICES = 4
SHORT_TEXTS = 32
#: Texts are compressed in blocks, so that the dictionary serves all of a long text.
BLOCK_BYTES = 8 << 10
LEVEL = 6
#: Texts that all dictionaries compress alike are tried once more at this level.
TIE_LEVEL = 19
MIN_MARGIN = 0.01
UNKNOWN = "und"

_OTHER = re.compile(r"[\W\d_]+")


def dictionaries(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionary content per language, most frequent first, from rows outside fold 2.

    The sample is bounded per language and chosen by the hash of the text; only it
    reaches the driver. Texts too short or too long for it serve languages that have too
    few others: long ones by slices, short ones joined.
    """
    known = docs.select("doc_id", F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 2)
    )
    frequent = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES)
    counts = {r["lang"]: r["count"] for r in frequent.collect()}
    known = known.filter(F.col("lang").isin(list(counts)) if counts else F.lit(False))
    rows = _sample(known.filter(F.length("text").between(*SAMPLE_CHARS)), SAMPLE_TEXTS)
    found: dict[str, list[bytes]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["r"])):
        found.setdefault(row["lang"], []).append(plain(row["text"]))
    few = [name for name in counts if len(found.get(name, [])) < SAMPLE_TEXTS]
    if few:
        _fill(found, known.filter(F.col("lang").isin(few)))
    out = {}
    for name in sorted(found, key=lambda n: (-counts[n], n)):
        content = b" ".join(dict.fromkeys(found[name]))
        out[name] = content[-DICTIONARY_BYTES:].ljust(8, b" ")
    return out


def _sample(known: DataFrame, n: int) -> list[Row]:
    """lang, r, text: the first ``n`` different texts of each language by their hashes."""
    hashed = known.select("lang", "text", F.xxhash64("text").alias("h"))
    order = Window.partitionBy("lang").orderBy("h")
    chosen = (
        hashed.select("lang", "h").distinct()
        .withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n)
    )
    return (
        hashed.join(F.broadcast(chosen), ["lang", "h"])
        .groupBy("lang", "r").agg(F.min("text").alias("text")).collect()
    )


def _fill(found: dict[str, list[bytes]], known: DataFrame) -> None:
    """Fill samples up to :data:`SAMPLE_TEXTS` from texts outside :data:`SAMPLE_CHARS`."""
    least, most = SAMPLE_CHARS
    size = F.length("text")
    width = most // SLICES
    step = ((size - width) / (SLICES - 1)).cast("int")
    slices = F.concat_ws(" ", *[F.substring("text", F.lit(1) + step * k, F.lit(width)) for k in range(SLICES)])
    long = known.filter(size > most).withColumn("text", slices)
    short = known.filter((size > 0) & (size < least))
    for part, joined in ((long, 1), (short, SHORT_TEXTS)):
        own: dict[str, list[bytes]] = {}
        for row in sorted(_sample(part, SAMPLE_TEXTS * joined), key=lambda r: (r["lang"], r["r"])):
            text = plain(row["text"])
            if text.strip():
                own.setdefault(row["lang"], []).append(text)
        for name, texts in own.items():
            have = found.setdefault(name, [])
            groups = [b" ".join(texts[k : k + joined]) for k in range(0, len(texts), joined)]
            have += groups[: max(SAMPLE_TEXTS - len(have), 0)]


def plain(text: str) -> bytes:
    """Lower-case words only: marks and figures tell nothing of the language."""
    return _OTHER.sub(" ", text.lower()).encode()


class Classifier:
    """``contents``: dictionaries by language; ties go to the earlier one."""

    def __init__(self, contents: dict[str, bytes]):
        self.names = list(contents)
        self._contents = contents
        self._compressors: dict[int, list] = {}

    def _at(self, level: int) -> list:
        import zstandard as zstd

        if level not in self._compressors:
            made = []
            for name in self.names:
                content = zstd.ZstdCompressionDict(
                    self._contents[name], dict_type=zstd.DICT_TYPE_RAWCONTENT
                )
                content.precompute_compress(level=level)
                made.append(
                    zstd.ZstdCompressor(
                        dict_data=content, level=level, write_content_size=False,
                        write_checksum=False, write_dict_id=False,
                    )
                )
            self._compressors[level] = made
        return self._compressors[level]

    def sizes(self, data: bytes, level: int = LEVEL) -> list[int]:
        blocks = [data[k : k + BLOCK_BYTES] for k in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self._at(level)]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score between 0 and 1, margin between 0 and 1."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        if len(self.names) == 1:
            return self.names[0], 1.0, 1.0
        data = plain(text)
        ranked = sorted((size, k) for k, size in enumerate(self.sizes(data)))
        if ranked[0][0] == ranked[1][0]:
            ranked = sorted((size, k) for k, size in enumerate(self.sizes(data, TIE_LEVEL)))
        margin = (ranked[1][0] - ranked[0][0]) / ranked[1][0]
        return self.names[ranked[0][1]], 0.5 + 0.5 * min(1.0, margin / 0.2), margin


def language_report(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, accepted; one row per document.

    NULL texts and texts without a letter are ``und`` with score 0 and not accepted; so
    are all texts where no language was learned.
    """
    contents = dictionaries(docs, text, lang)

    def predicted(batches):
        classifier = Classifier(contents)
        for batch in batches:
            found = [classifier.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"),
                 pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[2] for f in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score", "margin"],
            )

    given = docs.select(
        "doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), F.col(text).alias("text")
    )
    id_type = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(
        predicted,
        f"doc_id {id_type}, held_out boolean, lang_pred string, score double, margin double",
    ).withColumn("accepted", F.col("margin") >= MIN_MARGIN)
