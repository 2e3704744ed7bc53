"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gradeloom.llm.common import forgetful
from gradeloom.llm.pieces import PieceEncoder, Pieces, slices

NONE = 1 << 62
#: Bytes of text that are encoded at once, one row at least; chunks and pieces that a worker keeps within a task. A worker
#: takes its memory beside an executor's heap that may be at its most, so these are small.
SLICE, CHUNKS, PIECES = 1_000_000, 100_000, 50_000


class SegmentTreeBpe:
    """Merges pieces by the ranks of a byte-level vocabulary.

    A segment tree over the byte positions of a piece keeps, for each position, the rank of the pair that
    starts there; its root is the leftmost pair of least rank. A merge changes that position, its live
    left neighbour and the position that it swallows: three point updates of logarithmic cost. Short
    pieces are merged many at once, a row of a numpy array for each; long ones singly.
    """

    def __init__(self, ranks: dict[bytes, int], most: int = 64):
        self.ranks, self.most = ranks, most
        vocab = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            vocab[rank] = token
        self.width = np.array([len(v) for v in vocab])
        self.begin, self.bytes = np.cumsum(self.width) - self.width, np.frombuffer(b"".join(vocab), np.uint8)
        self.vocab, self.byte = vocab, np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self._hash_pairs(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))

    def _hash_pairs(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table of the pairs, looked up for whole arrays at once."""
        bits = max(int(4 * len(keys)).bit_length(), 4)
        self.mask, self.keys, self.values = (1 << bits) - 1, np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot = self._slot(keys >> 32, keys & 0xFFFFFFFF)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = keys[free]  # of several with one slot, the last stays
            done = self.keys[slot[left]] == keys[left]
            self.values[slot[left[done]]] = values[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a * 0x9E3779B1 + b * 0x85EBCA77
        return (x ^ (x >> 15)) & self.mask

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.astype(np.int64), b.astype(np.int64)
        key = np.where((a >= 0) & (b >= 0), a << 32 | b, -2)
        slot = self._slot(a, b)
        out = self.values[slot]
        held = self.keys[slot]
        todo = np.flatnonzero(((held != key) & (held >= 0)).ravel())
        out = np.where(held == key, out, -1).ravel()
        key, slot = key.ravel(), slot.ravel()
        todo = todo[key[todo] >= 0]
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            held = self.keys[slot[todo]]
            out[todo] = np.where(held == key[todo], self.values[slot[todo]], -1)
            todo = todo[(held != key[todo]) & (held >= 0)]
        return out.reshape(a.shape)

    def _merge_rows(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Pieces of at most `size` bytes, a power of two up to 64. A node holds rank * 64 + position."""
        rows, none = len(pieces), np.int32(2**31 - 1)
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(rows, size)
        wide = size + 1  # the last column stands for "no neighbour"
        token = np.full((rows, wide), -1, np.int32)
        token[:, :size] = np.where(np.arange(size) < lengths[:, None], self.byte[raw], -1)
        after = np.minimum(np.tile(np.arange(1, wide + 1, dtype=np.int32), (rows, 1)), size).ravel()
        before = np.tile(np.arange(-1, size, dtype=np.int32), (rows, 1)).ravel()
        tree = np.full((rows, 2 * size), none, np.int32)
        rank = self._rank(token[:, :size], token[:, 1:])
        tree[:, size:] = np.where(rank >= 0, rank * 64 + np.arange(size, dtype=np.int32), none)
        half = size // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        token, tree = token.ravel(), tree.ravel()

        def put(row, at, rank):
            base, node = row * (2 * size), at + size
            tree[base + node] = np.where(rank >= 0, rank * 64 + at, none)
            for _ in range(size.bit_length() - 1):
                node = node >> 1
                twin = base + 2 * node
                tree[base + node] = np.minimum(tree[twin], tree[twin + 1])

        row = np.flatnonzero(tree[1 :: 2 * size] < none)
        while len(row):
            root, base = tree[row * (2 * size) + 1], row * wide
            at, new = root & 63, root >> 6
            gone = after[base + at]
            then = after[base + gone]
            token[base + at], token[base + gone] = new, -1
            after[base + at] = then
            before[base + then] = at
            put(row, gone, np.full(len(row), -1, np.int32))
            left = before[base + at]
            has = left >= 0
            near = self._rank(np.concatenate([new, token[base[has] + left[has]]]), np.concatenate([token[base + then], new[has]]))
            put(row, at, near[: len(row)])
            put(row[has], left[has], near[len(row) :])
            row = row[tree[row * (2 * size) + 1] < none]
        token = token.reshape(rows, wide)[:, :size]
        live = token >= 0
        data, ends = token[live].astype("<u4").tobytes(), (4 * np.cumsum(live.sum(1))).tolist()
        return [data[s:e] for s, e in zip([0, *ends], ends)]

    def merge_one(self, piece: bytes) -> bytes:
        """The same for one piece, with plain lists."""
        n, get, vocab = len(piece), self.ranks.get, self.vocab  # two tokens merge to what their bytes are together
        size = 1 << max(n - 1, 0).bit_length()
        token = [int(self.byte[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            r = get(vocab[token[i]] + vocab[token[i + 1]])
            if r is not None:
                tree[size + i] = r << 32 | i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(at, value):
            node = at + size
            tree[node] = value
            while node > 1:
                node >>= 1
                value = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == value:
                    break
                tree[node] = value

        while tree[1] < NONE:
            at, new = tree[1] & 0xFFFFFFFF, tree[1] >> 32
            gone = after[at]
            then = after[at] = after[gone]
            token[at], token[gone] = new, -1
            put(gone, NONE)
            r = get(vocab[new] + vocab[token[then]]) if then < n else None
            put(at, NONE if r is None else r << 32 | at)
            if then < n:
                before[then] = at
            left = before[at]
            if left >= 0:
                r = get(vocab[token[left]] + vocab[new])
                put(left, NONE if r is None else r << 32 | left)
        return np.array([t for t in token if t >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        out: list = [None] * len(pieces)
        by_size: dict[int, list[int]] = {}
        raw = [p.encode() for p in pieces]
        for i, p in enumerate(raw):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > self.most:
                out[i] = self.merge_one(p)
            else:
                by_size.setdefault(1 << max(len(p) - 1, 1).bit_length(), []).append(i)
        for size, own in by_size.items():
            for k in range(0, len(own), 4096):
                part = own[k : k + 4096]
                for i, ids in zip(part, self._merge_rows([raw[i] for i in part], size), strict=True):
                    out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for, one after the other."""
        width = self.width[ids]
        ends = np.cumsum(width)
        at = np.repeat(self.begin[ids] - ends + width, width) + np.arange(ends[-1] if len(ends) else 0)
        return self.bytes[at]


@lru_cache(2)
def coder(path: str, pattern: str) -> tuple[SegmentTreeBpe, PieceEncoder]:
    """One coder for each vocabulary and Python worker."""
    with open(path, "rb") as f:
        bpe = SegmentTreeBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    return bpe, PieceEncoder(Pieces(pattern, bpe.encode_pieces, PIECES), bpe.width, CHUNKS)  # workers keep the vocabulary between tasks, not the memos


def _forgetful(path: str, pattern: str):
    return forgetful(lambda: coder(path, pattern)[1].forget())


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int32)))


def _sha256(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The hexadecimal digest of each part of data."""
    whole, ends = memoryview(np.ascontiguousarray(data)), at.tolist()
    return pa.array([hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text, each match of pattern merged separately. Null text has no ids."""

    @_forgetful(path, pattern)
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, ids_of = coder(path, pattern)
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                yield pa.RecordBatch.from_arrays([part.column(id_col), _lists(*ids_of(part.column(text_col)))], names=[id_col, "ids"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(work, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary): the bytes that each row's ids stand for. Null ids give no bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = coder(path, pattern)
        for batch in batches:
            for row in range(batch.num_rows):  # a row's bytes may be many times its ids
                ids = batch.column(ids_col).slice(row, 1).flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(row, 1), pa.array([bpe.decode(ids).tobytes()], pa.binary())], names=[id_col, "decoded"])

    rows = encoded.select(id_col, ids_col)
    return rows.mapInArrow(work, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, decoded binary")


def digested(batches: Iterator[pa.RecordBatch], path: str, pattern: str, id_col: str, text_col: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The work of a task of digests()."""
    bpe, ids_of = coder(path, pattern)
    for batch in batches:
        for part in slices(batch, text_col, SLICE):
            ids, at = ids_of(part.column(text_col))
            raw = bpe.decode(ids)
            bounds = np.concatenate([[0], np.cumsum(bpe.width[ids])])[at]
            columns = [part.column(id_col), pa.array(np.diff(at)), _sha256(ids.astype("<u4").view(np.uint8), 4 * at), _sha256(raw, bounds)]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                names.append("ids")
                columns.append(_lists(ids, at))
            yield pa.RecordBatch.from_arrays(columns, names=names)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded again; ids if asked for.

    Rows are handled one by one in parts of a few MB of text: null counts as empty, an empty text has no
    ids, repeated rows and ids keep their rows, other columns are ignored, an empty table gives no rows.
    """

    @_forgetful(path, pattern)
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return digested(batches, path, pattern, id_col, text_col, with_ids)

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(work, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{', ids array<int>' if with_ids else ''}")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents through the multilingual vocabulary and back."""
    import public_tokenizers

    from gradeloom.llm.common import table

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
