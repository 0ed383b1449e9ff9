"""Token ids of whole texts with a public vocabulary, one library call per new word only.

A text is cut at single spaces. Such a cut is a word boundary of the tokenizers used
here, so a piece has the same ids in every text; they are kept per Python worker, and
Arrow finds the distinct pieces of a batch. The results equal the library's own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from callweave.llm import hashing

#: Pieces known to a worker before it forgets the rare ones: bounds its memory.
KEPT_PIECES = 1_000_000
#: New pieces that are kept apart before they are sorted in among the others.
RECENT_PIECES = 100_000
#: Bytes of text that are cut and looked up at once.
SLICE_BYTES = 6 << 20
#: Pieces with their leading space, and white space, as the byte-level pattern cuts them.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: The same white space at the end of a piece, for Arrow's matcher.
_BLANK_END = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]$"


#: Words and marks that both patterns always cut apart; other pieces are looked up whole.
_PARTS = re.compile(r" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[.,:;!?*#$%&|<>]+|\n(?=[A-Za-z])")

#: A word as both patterns keep it whole and both normalisations treat it letter by letter.
_LETTERS = re.compile(r" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_SAMPLE = ("word", " Words", "Été", " straße", "a", "xyzzyx")


class CachedTokenizer:
    """``encode`` of an Arrow string array gives all ids in one array, and offsets.

    ``path`` is a file of the ``tokenizers`` library; NULL texts have no ids. A text that
    holds the string of a special token goes to the library whole, which gives such a string
    the token's own id.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._plain = Tokenizer.from_file(path)
        self._special = [t.content for t in self._plain.get_added_tokens_decoder().values()]
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        # White space is dropped where a space has no ids; there a piece needs no space.
        self._dropped = not self._tokenizer.encode("a b", add_special_tokens=False).ids[1:2] or (
            self._ids(" b") == self._ids("b")
        )
        self._mark = "\n" if not self._dropped else " ☃☃ "
        self._mark_ids = np.array(self._ids("b" + self._mark)[len(self._ids("b")):], np.uint32)
        self._byte_letters = _byte_letters()
        self._direct = all(self._word(w).tolist() == self._ids(w) for w in _SAMPLE)
        self._clear()

    def _ids(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _word(self, word: str) -> np.ndarray:
        """Ids of one run of letters, straight from the merges."""
        text = (word.strip().lower() if self._dropped else word).translate(self._byte_letters)
        return np.array([t.id for t in self._tokenizer.model.tokenize(text)], np.uint32)

    def _clear(self) -> None:
        # Two sorted tables of keys and numbers: all pieces, and the recent ones.
        self._known = [(np.zeros((2, 0), np.uint64), np.zeros(0, np.int32)) for _ in range(2)]
        self._count = 0
        self._starts = np.zeros(1024, np.int32)
        self._lengths = np.zeros(1024, np.int32)
        self._values = np.zeros(4096, np.uint32)
        self._used = 0
        self._hits = np.zeros(1024, np.uint8)

    def _forget(self) -> None:
        """Keep the pieces met again since they were learned, at most half of the bound."""
        hits = self._hits[: self._count]
        least = 1
        while (hits >= least).sum() > KEPT_PIECES // 2 and least < 255:
            least += 1
        keep = np.flatnonzero(hits >= least)[: KEPT_PIECES // 2]
        keys, codes = _merged(*self._known)
        values, ends = self._gather(keep)
        number = np.full(self._count, -1, np.int32)
        number[keep] = np.arange(len(keep))
        lengths = self._lengths[keep]
        self._clear()
        self._count, self._used = len(keep), len(values)
        self._starts = ends[:-1].astype(np.int32)
        self._lengths, self._values = lengths, values
        self._hits = np.zeros(len(keep), np.uint8)
        kept = number[codes] >= 0
        self._known[0] = (keys[:, kept], number[codes[kept]])

    def _add(self, pieces: list[str], codes: dict[str, int]) -> None:
        """Learn the ids of new pieces; many at once, as one text with marks between."""
        if self._direct:
            words = [p for p in pieces if _LETTERS.fullmatch(p)]
            tokenize, table = self._tokenizer.model.tokenize, self._byte_letters
            fold = str.lower if self._dropped else str
            found = [[t.id for t in tokenize(fold(w).translate(table))] for w in words]
            lengths = np.array([len(f) for f in found], np.int64)
            flat = np.fromiter((i for f in found for i in f), np.uint32, lengths.sum())
            self._append(words, flat, lengths, codes)
            pieces = [p for p in pieces if not _LETTERS.fullmatch(p)]
        together = [p for p in pieces if not _unsafe(p, self._mark)]
        alone = [p for p in pieces if _unsafe(p, self._mark)]
        for start in range(0, len(together), 4096):
            some = together[start : start + 4096]
            ids = np.array(self._ids(self._mark.join(some) + self._mark), np.uint32)
            ends = _positions(ids, self._mark_ids)
            if len(ends) != len(some):  # the mark is not what it seems: one by one
                alone += some
                continue
            begins = np.concatenate([[0], ends[:-1] + len(self._mark_ids)])
            keep = np.ones(len(ids), bool)
            for k in range(len(self._mark_ids)):
                keep[ends + k] = False
            self._append(some, ids[keep], ends - begins, codes)
        for start in range(0, len(alone), 1024):
            some = alone[start : start + 1024]
            found = [
                e.ids for e in self._tokenizer.encode_batch_fast(some, add_special_tokens=False)
            ]
            flat = np.fromiter((i for ids in found for i in ids), np.uint32)
            self._append(some, flat, np.array([len(ids) for ids in found], np.int64), codes)

    def _join(
        self, made: list[tuple[str, list[str]]], numbers: dict[str, int], codes: dict[str, int]
    ) -> None:
        """Learn pieces that are parts in a row from the ids of the parts."""
        counts = np.array([len(some) for _, some in made], np.int64)
        row = np.fromiter((numbers[p] for _, some in made for p in some), np.int64, counts.sum())
        ids, ends = self._gather(row)
        lengths = np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])
        self._append([p for p, _ in made], ids, lengths, codes)

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in a row, and where each piece begins."""
        lengths = self._lengths[codes]
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        shift = np.repeat(self._starts[codes] - ends[:-1], lengths)
        return self._values[shift + np.arange(ends[-1])], ends

    def _append(
        self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray, codes: dict[str, int]
    ) -> None:
        n, used = self._count, self._used
        self._starts = _room(self._starts, n + len(pieces))
        self._lengths = _room(self._lengths, n + len(pieces))
        self._hits = _room(self._hits, n + len(pieces))
        self._values = _room(self._values, used + len(ids))
        self._lengths[n : n + len(pieces)] = lengths
        self._starts[n : n + len(pieces)] = used + np.cumsum(lengths) - lengths
        self._values[used : used + len(ids)] = ids
        codes.update(zip(pieces, range(n, n + len(pieces))))
        self._count, self._used = n + len(pieces), used + len(ids)

    def _codes(self, pieces: pa.Array, spaced: bool = False) -> np.ndarray:
        """Numbers of pieces, or of the pieces behind a space; new ones are learned.

        Pieces are known by two 64-bit hashes in sorted arrays: a few dozen bytes each.
        """
        keys = piece_keys(pieces, spaced)
        order = np.argsort(keys[0])
        keys = keys[:, order]
        found = self._find(keys)
        new = np.flatnonzero(found < 0)
        again = np.unique(found[found >= 0])
        self._hits[again] = np.minimum(self._hits[again], 254) + 1
        if len(new):
            # Equal pieces stand together now; of each the first is learned.
            first = np.ones(len(new), bool)
            first[1:] = (keys[:, new[1:]] != keys[:, new[:-1]]).any(axis=0)
            names = pieces.take(pa.array(order[new[first]])).to_pylist()
            learned = self._learn([" " + n for n in names] if spaced else names)
            found[new] = learned[np.cumsum(first) - 1]
            self._remember(keys[:, new[first]], learned)
        codes = np.empty(len(found), np.int64)
        codes[order] = found
        return codes

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers for keys in ascending order, -1 where unknown."""
        found = np.full(keys.shape[1], -1, np.int64)
        for known, numbers in self._known:
            if len(numbers):
                at = np.minimum(np.searchsorted(known[0], keys[0]), len(numbers) - 1)
                same = (known[0, at] == keys[0]) & (known[1, at] == keys[1])
                found[same] = numbers[at[same]]
        return found

    def _remember(self, keys: np.ndarray, codes: np.ndarray) -> None:
        self._known[1] = _merged(self._known[1], (keys, codes.astype(np.int32)))
        if len(self._known[1][1]) > RECENT_PIECES:
            self._known[0] = _merged(*self._known)
            self._known[1] = (np.zeros((2, 0), np.uint64), np.zeros(0, np.int32))

    def _learn(self, names: list[str]) -> np.ndarray:
        """Numbers of new pieces in the order given."""
        parts = [_PARTS.findall(p) for p in names]
        whole = [len(q) < 2 or sum(map(len, q)) != len(p) for p, q in zip(names, parts)]
        codes: dict[str, int] = {}
        self._add([p for p, w in zip(names, whole) if w], codes)
        made = [(p, q) for p, q, w in zip(names, parts, whole) if not w]
        if made:
            own = list({part for _, q in made for part in q})
            numbers = dict(zip(own, self._codes(pa.array(own, pa.string())).tolist()))
            self._join(made, numbers, codes)
        return np.fromiter((codes[p] for p in names), np.int64, len(names))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        marked = np.zeros(len(texts), bool)
        for name in self._special:
            marked |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._encode_slices(texts)
        ids, offsets = self._encode_slices(pc.if_else(pa.array(marked), "", texts))
        rows = np.flatnonzero(marked)
        whole = [
            np.array(self._plain.encode(texts[int(row)].as_py(), add_special_tokens=False).ids, np.uint32)
            for row in rows
        ]
        lengths = np.diff(offsets)
        lengths[rows] = [len(w) for w in whole]
        ids = np.insert(ids, np.repeat(offsets[rows], lengths[rows]), np.concatenate(whole))
        return ids, np.concatenate([[0], np.cumsum(lengths)])

    def _encode_slices(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = pc.binary_length(texts).to_numpy()
        begins = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        ids, ends = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for lo, hi in hashing.chunks(begins, SLICE_BYTES):
            some, own = self._encode(texts.slice(lo, hi - lo))
            ids.append(some)
            ends.append(own[1:] + ends[-1][-1])
        return np.concatenate(ids), np.concatenate(ends)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self._count > KEPT_PIECES:
            self._forget()
        split = pc.ascii_split_whitespace if self._dropped else _split_spaces
        lists = split(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        coded = flat.dictionary_encode()
        names = coded.dictionary
        codes, counts = coded.indices.to_numpy().astype(np.int64), np.diff(offsets)
        if self._dropped:
            codes = self._codes(names)[codes]
        else:
            codes, counts = self._spaced(texts, flat, names, codes, offsets)
        ids, ends = self._gather(codes)
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]

    def _spaced(self, texts, flat, names, codes, offsets):
        """Pieces that start a text have no space; cuts inside white space are undone."""
        blank = pc.or_(pc.equal(names, ""), pc.match_substring_regex(names, _BLANK_END))
        odd = blank.to_numpy(zero_copy_only=False)[codes]
        bad = np.add.reduceat(np.append(odd, False).astype(np.int64), offsets[:-1]) > 0
        counts = np.diff(offsets)
        codes = self._codes(names, spaced=True)[codes]
        firsts = offsets[:-1][~bad]
        codes[firsts] = self._codes(flat.take(pa.array(firsts)))
        if not bad.any():
            return codes, counts
        parts = np.split(codes, offsets[1:-1])
        for row in np.flatnonzero(bad):  # such texts are cut by the pattern itself
            parts[row] = self._codes(pa.array(_PIECES.findall(texts[int(row)].as_py()), pa.string()))
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def piece_keys(pieces: pa.Array, spaced: bool) -> np.ndarray:
    """Two independent hashes of each piece, or of each with a space before it."""
    data, offsets = hashing.text_bytes(pieces)
    turn = 0xA5
    return np.stack([
        hashing.range_hashes(hashing.prefix_hashes(data ^ np.uint8(by)), offsets[:-1], offsets[1:],
                             32 ^ by if spaced else None)
        for by in (0, turn)
    ])


def _split_spaces(texts: pa.Array) -> pa.Array:
    return pc.split_pattern(texts, " ")


def _unsafe(piece: str, mark: str) -> bool:
    return mark.strip(" ") in piece or not piece or piece[-1].isspace() or "☃" in piece


def _positions(ids: np.ndarray, mark: np.ndarray) -> np.ndarray:
    hit = np.ones(max(len(ids) - len(mark) + 1, 0), bool)
    for k, value in enumerate(mark):
        hit &= ids[k : len(hit) + k] == value
    return np.flatnonzero(hit)


def _byte_letters() -> dict[int, str]:
    """The letters that stand for a character's bytes in byte-level vocabularies."""
    from tokenizers.pre_tokenizers import ByteLevel

    level = ByteLevel(add_prefix_space=False, use_regex=False)
    return {
        code: "".join(part for part, _ in level.pre_tokenize_str(chr(code)))
        for code in [32, *range(0xC0, 0x100)]
    }


def _merged(one: tuple, other: tuple) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([one[0], other[0]], axis=1)
    order = np.argsort(keys[0], kind="stable")
    return keys[:, order], np.concatenate([one[1], other[1]])[order]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    grown = np.zeros(max(size, len(array) + len(array) // 2), array.dtype)
    grown[: len(array)] = array
    return grown


_TOKENIZERS: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    """The worker's tokenizer for a vocabulary file; loaded once per Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]
