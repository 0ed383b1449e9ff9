"""Words of an Arrow text column as arrays: places and 64-bit hashes, without Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; a longer text is handled alone. Keeps the arrays in the cache.
CHUNK_BYTES = 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: A fixed random value per byte, so that hashes do not depend on the platform.
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(
    1, 1 << 63, 256, dtype=np.uint64
)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: ASCII white space, as in the pattern of a word.
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_POWERS[kind]) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _POWERS[kind] = np.cumprod(steps)
    return _POWERS[kind][:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text column, and where each text begins; NULL is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``size`` bytes together."""
    row, last = 0, len(offsets) - 1
    while row < last:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), last)
        yield row, end
        row = end


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums ``h`` with ``(h[e] - h[s]) * inverse**s`` the hash of bytes s to e."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _powers("up", _BASE, len(data)), out=out[1:])
    return out


def range_hashes(
    prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int | None = None
) -> np.ndarray:
    """Hashes of byte ranges; equal bytes have equal hashes wherever they stand.

    ``first``: as if each range began with this byte.
    """
    down = _powers("down", _INVERSE, len(prefix))
    raw, sizes = (prefix[ends] - prefix[starts]) * down[starts], (ends - starts).astype(np.uint64)
    if first is not None:
        raw, sizes = raw * _BASE + _BYTE_VALUES[first], sizes + np.uint64(1)
    return mix(raw + sizes)


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = WHITE, folded: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word, and where the words of each text begin.

    ``breaks`` marks the bytes between words; ``folded`` ignores ASCII case.
    """
    if folded:
        upper = (data >= 65) & (data <= 90)
        data = np.where(upper, data + 32, data).astype(np.uint8)
    inside = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    hashes = range_hashes(prefix_hashes(data), starts, ends)
    return hashes, np.searchsorted(starts, offsets)


def shingles(
    hashes: np.ndarray, offsets: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number, hash, number of occurrences.

    A text with fewer than ``width`` words has one shingle, all its words; one without
    words has none.
    """
    counts = np.diff(offsets)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    ends = np.cumsum(n)
    rows = np.repeat(np.arange(len(counts)), n)
    first = np.repeat(offsets[:-1] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
    out = np.zeros(len(first), np.uint64)
    last = offsets[1:][rows]
    for k in range(width):
        at = first + k
        word = np.where(at < last, hashes[np.minimum(at, max(len(hashes) - 1, 0))], np.uint64(0))
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word)
    order = np.lexsort((out, rows))
    rows, out = rows[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return rows[at], out[at], np.diff(np.append(at, len(out)))
