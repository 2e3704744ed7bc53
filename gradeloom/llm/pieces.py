"""Splitting texts into chunks that tokenizers never join, with a bounded memo of what was encoded before."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex


def _flags(values: list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[values] = True
    return out


#: Bytes that are white space, that open, close, or come second last in a character of white space (or in others too).
_SPACE, _OPEN = _flags([*range(9, 14), *range(28, 33)]), _flags([*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3])
_LAST, _BEFORE_LAST = _flags([*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]), _flags([0xC2, 0x9A, 0x80, 0x81])
_LETTER = _flags([*range(65, 91), *range(97, 123)])
#: Last bytes of the letters that begin with byte C3 (U+00C0 to U+00FF but for two signs); ASCII marks without the apostrophe.
_LATIN = _flags([b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])
_MARK = _flags([b for b in range(33, 127) if not chr(b).isalnum() and b != 39])


def _which(flags: np.ndarray, data: bytes) -> np.ndarray:
    """Which bytes are flagged."""
    return np.frombuffer(data.translate(flags.tobytes()), bool)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts, one after the other, and where each text begins and the last ends; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] else np.empty(0, np.uint8)
    return raw, at - at[0]


def cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of lone spaces inside texts: the pattern of byte-level BPE never matches across such a place.

    A space between two characters that are no white space ends the match before it and opens the one
    after it. Where bytes cannot tell a neighbour from white space beyond ASCII, no cut is made.
    """
    begin = np.zeros(len(raw) + 1, bool)
    begin[at] = True
    space = np.flatnonzero(raw == 32)
    space = space[~begin[space] & ~begin[space + 1]]
    last, then = raw[space - 1], raw[np.minimum(space + 1, max(len(raw) - 1, 0))]
    return space[~(_SPACE[last] | _OPEN[then] | (_LAST[last] & _BEFORE_LAST[raw[space - 2]]))]


def word_cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places of cuts(), those between an ASCII or Latin-1 letter and a mark after it, and those between a lone line feed
    after an ASCII letter or mark and an ASCII letter: the pattern never matches across these either.

    Words are the same chunk then, whatever mark or line surrounds them. Apostrophes are no such mark: 's is a match.
    """
    begin = np.zeros(len(raw) + 1, bool)
    begin[at] = True
    mark, feed = (np.flatnonzero(x & ~begin[:-1]) for x in (_which(_MARK, raw.tobytes()), raw == 10))
    last = raw[mark - 1]
    mark = mark[_LETTER[last] | (_LATIN[last] & (raw[mark - 2] == 0xC3))]
    feed = feed[~begin[feed + 1]]
    feed = feed[_LETTER[raw[feed + 1]] & (_LETTER | _MARK)[raw[feed - 1]]]
    return np.sort(np.concatenate([cuts(raw, at), mark, feed + 1]), kind="stable")


def plain_words(chunks: list[bytes]) -> np.ndarray:
    """Which chunks are ASCII and Latin-1 letters only, maybe after one space: each is one match of the pattern."""
    joined = b"".join([*chunks, b"a"])  # so that an empty chunk at the end has a place
    raw = np.frombuffer(joined, np.uint8)
    ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
    two = raw == 0xC3
    good = _which(_LETTER, joined) | two
    good[1:] |= two[:-1] & _which(_LATIN, joined)[1:]
    begin = np.concatenate([[0], ends[:-1]])
    good[begin] |= raw[begin] == 32
    return np.logical_and.reduceat(good, begin)


class Pieces:
    """Ids of texts from those of their pieces, the matches of the pattern; each new piece is encoded once.

    encode_pieces turns pieces into their ids as little-endian unsigned 32-bit numbers. The memo is emptied
    when it holds `entries` pieces, so memory stays bounded whatever the vocabulary.
    """

    def __init__(self, pattern: str, encode_pieces: Callable[[list[str]], list[bytes]], entries: int = 400_000):
        self.find, self.encode_pieces, self.entries = regex.compile(pattern).findall, encode_pieces, entries
        self.memo: dict[str, bytes] = {}

    def forget(self) -> None:
        self.memo.clear()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.find(t) for t in texts]
        if len(self.memo) > self.entries:
            self.memo.clear()
        new = list({p for s in split for p in s} - self.memo.keys())
        self.memo.update(zip(new, self.encode_pieces(new), strict=True))
        return [np.frombuffer(b"".join(map(self.memo.__getitem__, s)), "<u4") for s in split]


class PieceEncoder:
    """Token ids of many texts at once.

    encode turns texts into id arrays; width holds the bytes that each id stands for. Texts are cut into
    chunks, equal chunks of a call are found by Arrow, and only chunks not met before are encoded, joined
    to long texts, which a tokenizer cuts at the same places. A memo that has come to `entries` chunks
    keeps those that were asked for again, if they are half of it at most, so memory stays bounded
    whatever the vocabulary. cut finds the places between chunks. encode_words, if given, encodes the
    plain words among new chunks: all their ids, and how many each has.
    """

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], width: np.ndarray, entries: int = 800_000, cut: Callable[[np.ndarray, np.ndarray], np.ndarray] = cuts, encode_words: Callable[[list[bytes]], tuple[list[int], list[int]]] | None = None):
        self.encode, self.width, self.entries, self.cut, self.encode_words = encode, width, entries, cut, encode_words
        self._keep({}, np.empty(0, np.int64))

    def _keep(self, index: dict[bytes, int], kept: np.ndarray) -> None:
        """Start anew with these chunks, whose old numbers are kept."""
        size = self.ends[kept + 1] - self.ends[kept] if len(kept) else kept
        ends = np.concatenate([[0], np.cumsum(size)])
        self.ids = self.ids[np.repeat(self.ends[kept] - ends[:-1], size) + np.arange(ends[-1])] if len(kept) else np.empty(0, np.uint32)
        self.index, self.ends, self.again = index, ends, np.zeros(len(kept), bool)

    def _shrink(self) -> None:
        kept = np.flatnonzero(self.again)
        if 2 * len(kept) > self.entries:
            kept = kept[:0]
        words = np.array(list(self.index), object)[kept]
        self._keep(dict(zip(words.tolist(), range(len(kept)))), kept)

    def forget(self) -> None:
        """Empty the memo, and that of encode if it has one."""
        self._keep({}, np.empty(0, np.int64))
        if isinstance(self.encode, Pieces):
            self.encode.forget()

    def _learn(self, new: list[bytes]) -> np.ndarray:
        """Append the ids of new chunks to the memo; their numbers there."""
        if self.encode_words is None:
            return self._learn_texts(new)
        plain = plain_words(new)
        numbers = np.empty(len(new), np.int64)
        if plain.any():
            words = list(compress(new, plain))
            numbers[plain] = self._append(words, *self.encode_words(words))
        if not plain.all():
            numbers[~plain] = self._learn_texts(list(compress(new, ~plain)))
        return numbers

    def _append(self, chunks: list[bytes], ids: np.ndarray | list[int], counts: np.ndarray | list[int]) -> np.ndarray:
        """Append chunks with their ids to the memo; their numbers there."""
        base = len(self.index)
        self.index.update(zip(chunks, range(base, base + len(chunks))))
        self.ids = np.concatenate([self.ids, np.asarray(ids, np.uint32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.asarray(counts, np.int64))])
        self.again = np.concatenate([self.again, np.zeros(len(chunks), bool)])
        return np.arange(base, base + len(chunks))

    def _learn_texts(self, new: list[bytes]) -> np.ndarray:
        """Append the ids of new chunks, found from joined texts, to the memo; their numbers there."""
        opens, ends = _OPEN.tolist(), (_SPACE | _LAST).tolist()
        alike = [c[:1] == b" " and len(c) > 1 and not opens[c[1]] and not ends[c[-1]] for c in new]
        joined = [c for c, a in zip(new, alike, strict=True) if a]
        parts = [joined[k : k + 4096] for k in range(0, len(joined), 4096)]
        single = [c for c, a in zip(new, alike, strict=True) if not a]
        found = self.encode([*(b"".join(p).decode() for p in parts), *map(bytes.decode, single)])
        counts = [np.array([len(x) for x in found[len(parts) :]], np.int64)]
        for part, ids in zip(parts, found, strict=False):
            ends = np.cumsum(self.width[ids])
            counts.insert(-1, np.diff(np.searchsorted(ends, np.cumsum([0, *map(len, part)]), "right")))
        numbers = self._append([*joined, *single], np.concatenate(found), np.concatenate(counts))
        rank = np.array(alike)
        return numbers[np.where(rank, np.cumsum(rank) - 1, len(joined) + np.cumsum(~rank) - 1)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, at): text i has ids[at[i]:at[i + 1]]."""
        raw, at = text_bytes(texts)
        if not len(raw):
            return np.empty(0, np.uint32), np.zeros(len(at), np.int64)
        if len(self.index) > self.entries:
            self._shrink()
        cut = self.cut(raw, at)
        place = np.arange(len(at)) + np.searchsorted(cut, at)
        bounds = np.empty(len(at) + len(cut), np.int64)
        inner = np.ones(len(bounds), bool)
        inner[place] = False
        bounds[place], bounds[inner] = at, cut
        chunks = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        words, get = chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), self.index.get
        own = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        self.again[own[own >= 0]] = True
        if len(lost := np.flatnonzero(own < 0)):
            own[lost] = self._learn([words[i] for i in lost])
        code = chunks.indices.to_numpy()
        begin, size = self.ends[own], np.diff(self.ends)[own]
        size = size[code]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(begin[code] - ends[:-1], size) + np.arange(ends[-1])], ends[place]


def slices(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each, and one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)
