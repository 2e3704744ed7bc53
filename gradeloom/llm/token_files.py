"""Token-id output: blocks of ids coded by an adaptive context-mixing range coder.

A block holds whole texts and stands by itself: the model starts afresh, and a checksum of the ids is
checked on reading. Its ids are laid out in lanes of equal length that are coded side by side, one id of
every lane a step, with one model that all lanes share and that learns after each step.

Block layout, little-endian: magic "GLB2", ids (u32), lanes (u32), crc32 of the ids as u32 (u32), bytes of
a length (u8: 2 or 4), words of each lane, then the lanes' 16-bit words one after the other. Block rows
(shard, block, text ids and lengths, data) are kept in Parquet files, so Spark's committers place them on
any file system.
"""

from __future__ import annotations

import codecs
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import shared_dir, table
from gradeloom.llm.pieces import PieceEncoder, Pieces, slices, word_cuts

MAGIC = b"GLB2"
#: Ids of a block (it ends with the text that reaches them), its most lanes, steps between two counts.
BLOCK_IDS, LANES, REFRESH = 1 << 20, 8192, 8
#: log2 of the total of the mixed predictions' shares and of an id's frequencies; slots of the order-2 table.
MIX_BITS, ID_BITS, SLOTS = 12, 22, 1 << 18
#: Followers that a context of order 2 and 1 counts; the most that one counts before all are halved.
FOLLOWERS, MOST = (2, 3), 100
#: Frequencies are looked up by their upper bits first, then among the ids that share these.
COARSE_BITS = 7

_U = np.uint64
_LEAST, _ALL = _U(1 << 48), _U(2**64 - 1)
_ONCE, _TWICE, _ID = np.int32(1 << 21), np.int32(1 << 22), np.int32((1 << 21) - 1)
_PARTS = np.array([0, *((1 << 16) // np.arange(1, 1024))], np.int32)


class _Model:
    """Mixes the followers counted by contexts of order 2 and 1 with order-0 counts of all ids.

    A context of order 1 or 2 counts a few followers, in the order of their counts; one that is new
    takes the place of the last when that has been missed as often as met. Each order gets a weight that
    follows from how often, at these two totals, the id was among its followers; within it, followers
    share by their counts, and one that both orders know gets both shares. What is left goes to order 0,
    whose counts are never zero. All is integer arithmetic (one division is made in doubles, where it is
    exact), so encoder and decoder agree on any machine. Only a decoder identifies ids.
    """

    def __init__(self, alphabet: int, decodes: bool = False):
        if alphabet >= 1 << 21:
            raise ValueError("ids of at most 21 bits are coded")
        # count * 2 ** 21 + id, by rank; the followers of a context lie side by side and are moved as one number of 8 or 16 bytes.
        self.kept = [np.zeros(n, t) for n, t in ((SLOTS, np.int64), (alphabet, np.complex128))]
        self.hits = np.tile(np.array([1, 1, 6]), (256, 1))  # by both totals: found by order 2, else by order 1, else neither
        self.seen, self.id_start = np.zeros(alphabet, np.int64), np.zeros(alphabet + 1, np.int64)
        self.ids: list[np.ndarray] = []
        self.decodes = decodes
        self.refresh()

    def refresh(self) -> None:
        """Take the ids since the last time into the order-0 frequencies."""
        n = len(self.seen)
        if self.ids:
            self.seen += np.bincount(np.concatenate(self.ids), minlength=n)
            self.ids = []
        np.cumsum(1 + self.seen * ((1 << ID_BITS) - n) // max(int(self.seen.sum()), 1), out=self.id_start[1:])
        if self.decodes:  # the last id that starts at the begin of each cell or before it
            cells = (self.id_start + ((1 << COARSE_BITS) - 1)) >> COARSE_BITS
            self.coarse = np.cumsum(np.bincount(cells, minlength=(1 << ID_BITS - COARSE_BITS) + 1)) - 1

    def look(self, one: np.ndarray, two: np.ndarray) -> None:
        """Set the predictions after the last id, one, and that before it: followers with starts and sizes of their shares."""
        self.at = ((two * 50_021 + one) * 0x9E3779B1 >> 8) & (SLOTS - 1), one
        packed = self.packed = np.empty((sum(FOLLOWERS), len(one)), np.int32)
        begin = 0
        for kept, at, k in zip(self.kept, self.at, FOLLOWERS, strict=True):
            packed[begin : begin + k] = kept.take(at).view(np.int32).reshape(len(at), -1).T[:k]
            begin += k
        self.known, self.count = packed & _ID, packed >> 21
        parts = slice(0, FOLLOWERS[0]), slice(FOLLOWERS[0], None)
        total = [sum(self.count[p][1:], self.count[p][0]) for p in parts]
        self.bucket = (np.minimum(total[0], 15) * 16 + np.minimum(total[1], 15)).astype(np.int64)
        weight = (self.hits[:, :2] * ((1 << MIX_BITS) - 1) // self.hits.sum(1, keepdims=True)).astype(np.int32).T.copy()
        share = self.count.copy()
        for o in (0, 1):
            share[parts[o]] *= weight[o].take(self.bucket) * _PARTS.take(total[o])
        share >>= 16
        share = share.astype(np.int16)  # 2 ** MIX_BITS at most
        low = share[parts[1]]
        for j in range(FOLLOWERS[0]):  # a follower that both orders know is kept once, by order 2
            moved = low * (self.known[parts[1]] == self.known[j])
            share[j] += sum(moved[1:], moved[0])
            low -= moved
        self.share, self.start = share, np.empty_like(share)
        self.rest = np.int16(1 << MIX_BITS) - share.sum(0, dtype=np.int16)
        begin = self.rest
        for j in range(len(share)):
            self.start[j] = begin
            begin = begin + share[j]

    def _meet(self, ids: np.ndarray) -> None:
        self.hit = (self.known == ids.astype(np.int32)) & (self.count > 0)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each id's share of 2 ** (MIX_BITS + ID_BITS)."""
        self._meet(ids)
        size = (self.share * self.hit).sum(0, dtype=np.int16)  # of two places of an id one has no share
        start = (self.start * (self.hit & (self.share > 0))).sum(0, dtype=np.int16).astype(np.int64)
        rest, at = self.rest * (size == 0), self.id_start.take(ids)
        return (start << ID_BITS) + rest * at, (size.astype(np.int64) << ID_BITS) + rest * (self.id_start.take(ids + 1) - at)

    def identify(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids in whose shares the values are, and the starts and sizes of these."""
        place = (self.start <= (value >> ID_BITS).astype(np.int16)).view(np.int8).sum(0, dtype=np.int8) - np.int8(1)
        n = len(place)
        at = np.maximum(place, 0) * np.int64(n) + np.arange(n)
        ids, start, size = (x.ravel().take(at).astype(np.int64) for x in (self.known, self.start, self.share))
        start <<= ID_BITS
        size <<= ID_BITS
        new = np.flatnonzero(place < 0)
        rest = self.rest.take(new)
        value = (value.take(new) / rest).astype(np.int64)  # below 2 ** 34 by at most 2 ** 12: no quotient is rounded up to a whole number
        cell = value >> COARSE_BITS
        found = self.coarse.take(cell)
        more = np.flatnonzero(self.coarse.take(cell + 1) != found)
        for _ in range(3):  # most are one of the next ids
            more = more[self.id_start.take(found.take(more) + 1, mode="clip") <= value.take(more)]  # damaged blocks lead past the last
            found[more] += 1
        if len(more):
            found[more] = np.searchsorted(self.id_start, value[more], "right") - 1
        found = np.minimum(found, len(self.seen) - 1)
        low = self.id_start.take(found)
        ids[new], start[new], size[new] = found, rest * low, rest * (self.id_start.take(found + 1) - low)
        self._meet(ids)
        return ids, start, size

    def learn(self, ids: np.ndarray) -> None:
        """Count the ids; interval() or identify() has met them."""
        self.ids.append(ids)
        packed, hit, begin, lost = self.packed, self.hit, 0, []
        packed += hit * _TWICE
        new = _TWICE + ids.astype(np.int32)
        for kept, at, k in zip(self.kept, self.at, FOLLOWERS, strict=True):
            own = packed[begin : begin + k]
            missed = ~np.logical_or.reduce(hit[begin : begin + k])
            lost.append(missed.view(np.int8))
            own[-1] -= missed * _ONCE
            np.maximum(own[-1], new * (missed & (own[-1] < _ONCE)), out=own[-1])  # new is larger than any that it replaces
            for j in range(k - 1, 0, -1):
                own[j - 1], own[j] = np.maximum(own[j - 1], own[j]), np.minimum(own[j - 1], own[j])
            if len(full := np.flatnonzero(own[0] > MOST * _ONCE)):
                own[:, full] = (own[:, full] >> 22 << 21) | (own[:, full] & _ID)
            wide = kept.itemsize // 4
            side = np.zeros(len(at) * wide, np.int32)
            for j in range(k):
                side[j::wide] = own[j]
            kept[at] = side.view(kept.dtype)  # of lanes in one context the last stays
            begin += k
        self.hits += np.bincount(self.bucket * 3 + lost[0] * (lost[1] + np.int8(1)), minlength=768).reshape(256, 3)


def _across(x: np.ndarray) -> np.ndarray:
    """x.T laid out in its own order, some rows of x at a time, which stay in the cache."""
    out = np.empty(x.shape[::-1], x.dtype)
    for k in range(0, len(x), 256):
        out[:, k : k + 256] = x[k : k + 256].T
    return out


class _Encoder:
    """Codes one id of every lane a step. The first words of all lanes lie side by side, then the second ones: lanes go ahead evenly."""

    def __init__(self, lanes: int, room: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, _ALL, _U)
        self.out, self.lanes, self.at = np.zeros(lanes * room, "<u2"), np.int64(lanes), np.arange(lanes)

    def _carry(self, lane: np.ndarray) -> None:
        at = self.at[lane] - self.lanes
        while len(at):
            self.out[at] += 1
            at = at[self.out[at] == 0] - self.lanes

    def put(self, start: np.ndarray, size: np.ndarray, bits: int) -> None:
        r = self.range >> _U(bits)
        low = self.low + r * start.astype(_U)
        if len(over := np.flatnonzero(low < self.low)):
            self._carry(over)
        self.low, self.range = low, r * size.astype(_U)
        short = self.range < _LEAST
        self.out[self.at] = low >> _U(48)  # where a lane gives no word, its next one takes this place
        self.at += short * self.lanes
        shift = short * _U(0xFFFF) + _U(1)
        self.low *= shift
        self.range *= shift
        while len(lane := np.flatnonzero(self.range < _LEAST)):  # about half of the lanes give a word, few of them another
            a = self.low[lane]
            self.out[self.at[lane]] = a >> _U(48)
            self.at[lane] += self.lanes
            self.low[lane], self.range[lane] = a << _U(16), self.range[lane] << _U(16)

    def finish(self) -> None:
        """One more word for each lane: a value in its interval, with zeros after it."""
        low = self.low + (_LEAST - _U(1))
        self._carry(np.flatnonzero(low < self.low))
        self.out[self.at] = low >> _U(48)
        self.at += self.lanes

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The words of all lanes, one lane after the other, and how many each has."""
        used = self.at // self.lanes
        room = np.arange(used.max())
        return _across(self.out.reshape(-1, len(used))[: len(room)])[room < used[:, None]], used


class _Decoder:
    def __init__(self, words: np.ndarray, used: np.ndarray):
        room = int(used.max()) + 4  # zeros follow the words of a lane
        table = np.zeros((len(used), room), np.uint16)
        table[np.arange(room) < used[:, None]] = words
        self.words, self.lanes, self.at = _across(table).ravel(), np.int64(len(used)), np.arange(len(used))  # as the encoder has them
        self.code, self.range = np.zeros(len(used), _U), np.full(len(used), _ALL, _U)
        for _ in range(4):
            self.code = self.code << _U(16) | self.words[self.at]
            self.at += self.lanes

    def value(self, bits: int) -> np.ndarray:
        self.unit = self.range >> _U(bits)
        return np.minimum(self.code // self.unit, _U((1 << bits) - 1)).astype(np.int64)

    def take(self, start: np.ndarray, size: np.ndarray) -> None:
        code, rng = self.code - self.unit * start.astype(_U), self.unit * size.astype(_U)
        short = rng < _LEAST
        shift = short * _U(0xFFFF) + _U(1)
        code *= shift
        rng *= shift
        code |= self.words.take(self.at, mode="clip") * short.astype(_U)
        self.at += short * self.lanes
        while len(lane := np.flatnonzero(rng < _LEAST)):
            code[lane] = code[lane] << _U(16) | self.words[np.minimum(self.at[lane], len(self.words) - 1)]
            self.at[lane] += self.lanes
            rng[lane] <<= _U(16)
        self.code, self.range = code, rng


def _lanes(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // 64))
    return lanes, -(-n // lanes)


def _counts(step: int) -> bool:
    """Whether the model counts before this step: often at first, then every REFRESH steps."""
    return step in (1, 2, 4) or step > 0 and step % REFRESH == 0


def encode_block(ids: np.ndarray, alphabet: int) -> bytes:
    """One block of ids below alphabet."""
    ids = ids.astype("<u4")
    n = len(ids)
    lanes, steps = _lanes(n)
    x = np.zeros(lanes * steps, np.int32)
    x[:n] = ids
    x = _across(x.reshape(lanes, steps))
    model, coder = _Model(alphabet), _Encoder(lanes, 3 * steps + 8)
    one = two = np.zeros(lanes, np.int64)
    for t in range(steps):
        if _counts(t):
            model.refresh()
        model.look(one, two)
        now = x[t].astype(np.int64)
        coder.put(*model.interval(now), MIX_BITS + ID_BITS)
        model.learn(now)
        one, two = now, one
    coder.finish()
    words, used = coder.words()
    width = 2 if used.max() < 65536 else 4
    return b"".join([MAGIC, struct.pack("<IIIB", n, lanes, zlib.crc32(ids.tobytes()), width), used.astype(f"<u{width}").tobytes(), words.tobytes()])


def decode_block(data: bytes, alphabet: int) -> np.ndarray:
    """The ids of a block; ValueError where it is damaged."""
    if data[:4] != MAGIC:
        raise ValueError("not a token block")
    n, lanes, crc, width = struct.unpack_from("<IIIB", data, 4)
    used = np.frombuffer(data, f"<u{width}", lanes, 17).astype(np.int64)
    words = np.frombuffer(data[17 + width * lanes :], "<u2")
    if used.sum() != len(words):
        raise ValueError("a token block is cut short")
    steps = -(-n // lanes)
    x = np.zeros((steps, lanes), np.uint32)
    model, coder = _Model(alphabet, decodes=True), _Decoder(words, used)
    one = two = np.zeros(lanes, np.int64)
    for t in range(steps):
        if _counts(t):
            model.refresh()
        model.look(one, two)
        now, *share = model.identify(coder.value(MIX_BITS + ID_BITS))
        coder.take(*share)
        model.learn(now)
        x[t] = now
        one, two = now, one
    ids = x.T.ravel()[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a token block has the wrong checksum")
    return ids


def _word_encoder(own) -> Callable[[list[bytes]], tuple[list[int], list[int]]] | None:
    """The library's model on words, each one piece: all ids and how many each word has. None where more than byte-level pieces comes before the model."""
    from tokenizers import pre_tokenizers

    before = own.pre_tokenizer
    if own.normalizer or own.truncation or own.padding or not isinstance(before, pre_tokenizers.ByteLevel) or before.add_prefix_space or not before.use_regex:
        return None
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}  # byte-level vocabularies write these bytes as they are, others from U+0100 on
    others = iter(range(256, 512))
    chars = [chr(b if b in kept else next(others)) for b in range(256)]
    chars[10] = "\n"  # between words, never in one
    chars = "".join(chars)
    tokenize = own.model.tokenize

    def encode_words(words: list[bytes]) -> tuple[list[int], list[int]]:
        ids, counts = [], []
        for word in codecs.charmap_decode(b"\n".join(words), "strict", chars)[0].split("\n"):
            tokens = tokenize(word)
            counts.append(len(tokens))
            ids += [t.id for t in tokens]
        return ids, counts

    return encode_words


@lru_cache(2)
def tokenizer(path: str, pattern: str):
    """Ids of texts, as from PieceEncoder, and the size of the vocabulary; pattern cuts as the tokenizer itself does."""
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    own = Tokenizer.from_file(path)
    added = [t.content for t in own.get_added_tokens_decoder().values()]
    alphabet = own.get_vocab_size(with_added_tokens=True)
    width = np.zeros(alphabet, np.int64)
    for token, i in own.get_vocab(with_added_tokens=True).items():
        width[i] = len(token)  # a character for each byte

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in own.encode_batch_fast(texts, add_special_tokens=False)]

    apart = Pieces(pattern, lambda new: [ids.astype("<u4").tobytes() for ids in encode(new)])

    def encode_chunks(texts: list[str]) -> list[np.ndarray]:
        """The library cuts joined chunks into pieces itself; only where it would take an added token out first, pieces are cut for it."""
        odd = [i for i, t in enumerate(texts) if any(token in t for token in added)]
        plain = [t for i, t in enumerate(texts) if i not in set(odd)] if odd else texts
        found = encode(plain)
        for i, ids in zip(odd, apart([texts[i] for i in odd]), strict=True):
            found.insert(i, ids)
        return found

    pieces = PieceEncoder(encode_chunks, width, cut=word_cuts, encode_words=_word_encoder(own))

    def ids_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids, at = pieces(texts)
        whole = np.zeros(len(texts), bool)  # the library takes added tokens out before it looks for pieces
        for token in added:
            whole |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        if whole.any():
            parts = [ids[a:b] for a, b in zip(at, at[1:])]
            for i in np.flatnonzero(whole):
                parts[i] = encode([texts[i].as_py()])[0]
            ids, at = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return ids, at

    return ids_of, alphabet


def write(docs: DataFrame, out: str, path: str, pattern: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Write every whole text's ids and end_id, in ascending id order, as block files under out.

    Rows are dealt into ranges of ids and sorted there (then by text; null ids first), so a shard is a
    range and shard after shard is the whole order. pattern must cut as the tokenizer's own pre-tokenizer, and
    never match across a lone space, from an ASCII or Latin-1 letter to an ASCII mark after it (apostrophes aside), or
    from a lone line feed after one of these to an ASCII letter. Null text counts as empty: its end alone.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, made = TaskContext.get().partitionId(), 0
        ids_of, alphabet = tokenizer(path, pattern)
        keys, lengths, ids, total, end = [], [], [], 0, np.array([end_id], np.uint32)

        def block() -> pa.RecordBatch:
            data, row = encode_block(np.concatenate(ids), alphabet), pa.concat_arrays(keys)
            sizes = np.concatenate(lengths)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), x) for x in (row, pa.array(sizes, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([made], pa.int32()), *lists, pa.array([total], pa.int64()), pa.array([data], pa.binary())], names=["shard", "block", "ids", "lengths", "n_ids", "data"])

        for batch in batches:
            for rows in slices(batch, text_col, 8_000_000):
                found, at = ids_of(rows.column(1))
                found, at = np.concatenate([x for a, b in zip(at, at[1:]) for x in (found[a:b], end)]), at + np.arange(len(at))
                begin = 0
                while begin < len(at) - 1:
                    stop = min(int(np.searchsorted(at, at[begin] + BLOCK_IDS - total)), len(at) - 1)  # the text that fills the block, or the last
                    keys.append(rows.column(0).slice(begin, stop - begin))
                    lengths.append(np.diff(at[begin : stop + 1]))
                    ids.append(found[at[begin] : at[stop]])
                    total += int(at[stop] - at[begin])
                    begin = stop
                    if total >= BLOCK_IDS:
                        yield block()
                        made += 1
                        keys, lengths, ids, total = [], [], [], 0
        if keys:
            yield block()

    rows = docs.select(id_col, text_col)
    rows = rows.repartitionByRange(partitions, id_col) if partitions else rows.repartitionByRange(id_col)
    rows = rows.sortWithinPartitions(id_col, text_col)
    rows.mapInArrow(work, f"shard int, block int, ids array<{kind}>, lengths array<long>, n_ids long, data binary").write.parquet(out)


def read(spark: SparkSession, path: str, alphabet: int) -> DataFrame:
    """(id, start, tokens binary) of every text in block files, decoded and checked.

    start counts the ids of all texts before it. Only the totals of shards, a row each, meet in one task.
    """
    files = spark.read.parquet(path)
    kind = files.schema["ids"].dataType.elementType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                at = np.concatenate([[0], np.cumsum(batch.column(2)[r].values.to_numpy())])
                raw = decode_block(batch.column(3)[r].as_py(), alphabet)
                tokens = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column(1)[r].values, pa.array(at[:-1] + batch.column(0)[r].as_py()), tokens], names=["id", "start", "tokens"])

    sizes = files.select("shard", "block", "n_ids")
    blocks = sizes.withColumn("in_shard", F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    totals = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    places = blocks.join(totals, "shard").select("shard", "block", (F.col("before") + F.col("in_shard")).alias("offset"))
    rows = files.join(places, ["shard", "block"]).select("offset", "ids", "lengths", "data")  # joined while still coded
    return rows.mapInArrow(work, f"id {kind}, start long, tokens binary")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents written as block files and read back from them."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = f"{shared_dir(spark)}/tables/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), out, path, public_tokenizers.PATTERN)
    _, alphabet = tokenizer(path, public_tokenizers.PATTERN)
    n = (F.octet_length("tokens") / 4).cast("long")
    return read(spark, out, alphabet).select(F.col("id").alias("doc_id"), "start", n.alias("n_tokens"), F.crc32("tokens").alias("ids_crc32"))
