"""Quality classifier: random-indexing word vectors, pooled for each document, and a two-layer network."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import forgetful, table
from gradeloom.llm.pieces import slices

#: Words share so many vectors (by hash), so the model has one size whatever the corpus; their length;
#: entries that are not zero in an index vector; neighbours on each side that make a context.
BUCKETS, SIZE, NONZERO, REACH = 1 << 14, 48, 4, 2
#: Parts in which a table of vectors travels, and labelled rows that the network is fitted on at most.
PARTS, TRAIN_ROWS = 64, 6000

_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")


def _shape(token: bytes) -> bytes:
    if token[0] in b"0123456789":
        return b"\x000"
    if not (token.isalpha() or token[0] >= 0x80):
        return b"\x00" + token[:1] * min(len(token), 4)
    letters = bytes(c for c in token if c < 0x80)
    if letters and letters == letters.upper() and len(token) > 1:
        return b"\x00AA"
    return b"\x00Aa" if letters[:1].isupper() else b"\x00aa"


class _Buckets(dict):
    """token -> vector of the word, and that of its shape in the upper bits; emptied when full."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        found = self[token] = zlib.crc32(token) % BUCKETS | zlib.crc32(_shape(token)) % BUCKETS << 20
        return found


_buckets = _Buckets()


def _forget() -> None:
    _buckets.clear()


def buckets(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Vector numbers of a text's tokens and of their shapes."""
    tokens = _TOKEN.findall(text.encode()) if text else []
    both = np.fromiter(map(_buckets.__getitem__, tokens), np.int64, len(tokens))
    return both & 0xFFFFF, both >> 20


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the sparse random vector of each bucket; the same everywhere."""
    rng = np.random.default_rng(7)
    place = np.argsort(rng.random((BUCKETS + 1, SIZE)), axis=1)[:, :NONZERO].astype(np.int64)
    sign = rng.choice([-1.0, 1.0], (BUCKETS + 1, NONZERO))
    sign[BUCKETS] = 0  # stands between texts
    return place, sign


def context_sums(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The sum of the neighbours' index vectors for each bucket, over all rows of docs.

    Each task sends one compressed table in PARTS parts; parts are added in two steps, salted first, so
    no task holds more than a share of them. What reaches the driver has a fixed size.
    """

    @forgetful(_forget)
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, sign = index_vectors()
        total = np.zeros(BUCKETS * SIZE)
        for batch in batches:
            for part in slices(batch, text_col):
                rows = []
                for text in part.column(0).to_pylist():
                    rows += [buckets(text)[0], np.full(REACH, BUCKETS)]
                word = np.concatenate(rows) if rows else np.empty(0, np.int64)
                for step in range(1, REACH + 1):
                    for a, b in ((word[:-step], word[step:]), (word[step:], word[:-step])):
                        own = a < BUCKETS
                        a, b = a[own], b[own]
                        for k in range(NONZERO):
                            total += np.bincount(a * SIZE + place[b, k], sign[b, k], BUCKETS * SIZE)
        data = [zstandard.ZstdCompressor(1).compress(x.astype("<i8").tobytes()) for x in np.split(total, PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([TaskContext.get().partitionId() % 32] * PARTS, pa.int32()), pa.array(data, pa.binary())], names=["part", "salt", "data"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * SIZE // PARTS, np.int64)
        for batch in batches:
            for x in batch.column(batch.schema.get_field_index("data")):
                total += np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), "<i8")
        data = zstandard.ZstdCompressor(1).compress(total.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([data], pa.binary())], names=["part", "data"])

    sums = docs.select(text_col).mapInArrow(work, "part int, salt int, data binary")
    sums = sums.groupBy("part", "salt").applyInArrow(add, "part int, data binary")
    sums = sums.groupBy("part").applyInArrow(add, "part int, data binary")
    out = np.zeros((PARTS, BUCKETS * SIZE // PARTS), np.int64)
    for row in sums.collect():  # PARTS rows of fixed size
        out[row["part"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row["data"])), "<i8")
    return out.reshape(BUCKETS, SIZE)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Each word's own index vector and its context's direction."""
    place, sign = index_vectors()
    own = np.zeros((BUCKETS, SIZE))
    np.put_along_axis(own, place[:BUCKETS], sign[:BUCKETS], 1)
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    return (own / np.sqrt(NONZERO) + sums / np.maximum(length, 1)).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors, mean of the shapes' vectors, log length, shares of distinct and of doubled words."""
    word, shape = buckets(text)
    if not len(word):
        return np.zeros(3 * SIZE + 3, np.float32)
    own = vectors[word]
    few, counts = np.unique(shape, return_counts=True)
    extra = [np.log1p(len(word)), len(np.unique(word)) / len(word), (word[1:] == word[:-1]).mean() if len(word) > 1 else 0.0]
    return np.concatenate([own.mean(0), own.std(0), counts @ vectors[few] / len(word), extra]).astype(np.float32)


@dataclass(frozen=True)
class Network:
    """Standardised inputs, a tanh layer, a logistic output whose logit is divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 400) -> Network:
    """Full-batch Adam on four fifths of the rows; the last fifth chooses the temperature.

    Without rows of both classes the network is constant: the share of ones, or one half.
    """
    width = x.shape[1]
    if len(y) < 10 or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    held = np.arange(len(y)) % 5 == 4
    xt, yt = x[~held], y[~held]
    mean, scale = xt.mean(0), xt.std(0) + 1e-3
    z, rng = (xt - mean) / scale, np.random.default_rng(1)
    p = [rng.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), np.array(0.0)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, rounds + 1):
        h = np.tanh(z @ p[0] + p[1])
        g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - yt) / len(yt)
        back = np.outer(g, p[2]) * (1 - h * h)
        grads = [z.T @ back + 1e-4 * p[0], back.sum(0), h.T @ g + 1e-4 * p[2], g.sum()]
        for k, d in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
            p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, *p[:3], float(p[3]))
    logit, yh = net.logits(x[held]), y[held]
    steps = np.geomspace(0.5, 8, 41)
    loss = [np.logaddexp(0, np.where(yh > 0, -logit, logit) / t).mean() for t in steps]
    return Network(mean, scale, *p[:3], float(p[3]), float(steps[int(np.argmin(loss))]))


def held_out(id_col: str) -> Column:
    """crc32 of the id as text is divisible by 5; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors from all rows of docs; the network from at most `rows` labelled ones.

    Those are the labelled rows of least id hash among the ids that are not held out; rows without id,
    label or document are left out. Only their pooled vectors reach the driver.
    """
    vectors = word_vectors(context_sums(docs, text_col))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.select(id_col, F.col(label_col).cast("double").alias("label")).orderBy(F.xxhash64(id_col), "label").limit(rows)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    @forgetful(_forget)
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [pooled(t, sent.value).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.binary())], names=["id", "label", "x"])

    rows_ = docs.select(id_col, text_col).join(F.broadcast(known), id_col)
    rows_ = rows_.groupBy(id_col, "label").agg(F.min_by(text_col, F.xxhash64(text_col)).alias(text_col)).select(id_col, text_col, "label")  # one text of a repeated id
    kind = rows_.schema[id_col].dataType.simpleString()
    got = sorted(((r["id"], r["label"], bytes(r["x"])) for r in rows_.mapInArrow(work, f"id {kind}, label double, x binary").collect()), key=lambda r: (zlib.crc32(str(r[0]).encode()), r))
    x = np.frombuffer(b"".join(r[2] for r in got), np.float32).reshape(len(got), 3 * SIZE + 3).astype(float)
    return vectors, fit(x, np.array([r[1] for r in got]))


def score(docs: DataFrame, model: tuple[np.ndarray, Network], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text: the probability of label 1.

    Null counts as empty, and an empty text has the score of no words. Repeated rows keep their rows;
    an empty table gives no rows. Only the text is an input.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @forgetful(_forget)
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = sent.value
        for batch in batches:
            for part in slices(batch, text_col):
                x = np.array([pooled(t, vectors) for t in part.column(1).to_pylist()], float)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(net.score(x))], names=["id", "score"])

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(work, f"id {rows.schema[id_col].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: tuple[np.ndarray, Network], threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores at least threshold. Rows are neither joined nor moved."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @forgetful(_forget)
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = sent.value
        for batch in batches:
            for part in slices(batch, text_col):
                x = np.array([pooled(t, vectors) for t in part.column(text_col).to_pylist()], float)
                yield part.filter(pa.array(net.score(x) >= threshold))

    return docs.mapInArrow(work, docs.schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
