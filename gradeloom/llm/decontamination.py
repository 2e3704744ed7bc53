"""Benchmark decontamination by a positional inverted index of the training documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import saved, table
from gradeloom.llm.words import words

#: Words of a window; free positions between two documents of a shard; bytes of text that make a shard.
WINDOW, GAP, SHARD_BYTES = 10, 64, 8_000_000
#: Characters of benchmark text that are searched at a time; a larger benchmark is taken in blocks.
BLOCK_CHARS = 8_000_000
SHARD = "shard string, ids array<{id}>, n_words array<int>, bases array<int>, terms array<string>, counts array<int>, postings binary"


@dataclass(frozen=True)
class Windows:
    """Windows of one block of items: term ids (-1 beyond a short window's end), each window's item."""

    terms: list[bytes]
    term: np.ndarray
    item: np.ndarray
    item_ids: list


def item_windows(items: list[tuple], size: int = WINDOW) -> Windows:
    """All runs of `size` words of each (item_id, text); fewer words make one window, none make none."""
    vocabulary: dict[bytes, int] = {}
    rows, own = [], []
    for n, (_, text) in enumerate(items):
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
        for run in {tuple(ids[i : i + size]) for i in range(max(1, len(ids) - size + 1))} - {()}:
            rows.append(run + (-1,) * (size - len(run)))
            own.append(n)
    return Windows(list(vocabulary), np.array(rows, np.int32).reshape(len(rows), size), np.array(own, np.int32), [i for i, _ in items])


def build_index(docs: DataFrame, vocabulary: list[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A document-partitioned positional index: one row for each shard of about SHARD_BYTES of text.

    terms, counts and postings are the inverted lists: for each term the ascending positions of its
    occurrences, counted through the shard with a gap after each document (bases has each one's first).
    With a vocabulary only its terms are stored. A word that every document has is spread over all
    shards, so no list grows beyond its shard. Null text has no words.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = None if vocabulary is None else {w: i for i, w in enumerate(vocabulary)}

    def shard(name: str, ids: pa.Array, lengths: list[int], positions: list, terms: list, known: dict) -> pa.RecordBatch:
        at = np.concatenate(positions) if positions else np.empty(0, np.int32)
        term = np.concatenate(terms) if terms else np.empty(0, np.int32)
        order = np.argsort(term, kind="stable")
        term, at = term[order], at[order]
        used, counts = np.unique(term, return_counts=True)
        names = list(known)
        ends = np.cumsum([0, *(n + GAP for n in lengths)])
        data = zstandard.ZstdCompressor(1).compress(np.diff(at, prepend=0).astype("<i4").tobytes())
        columns = [pa.array([name]), ids, pa.array([lengths], pa.list_(pa.int32())), pa.array([ends[:-1].tolist()], pa.list_(pa.int32())), pa.array([[names[i].decode() for i in used]], pa.list_(pa.string())), pa.array([counts.tolist()], pa.list_(pa.int32())), pa.array([data], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "ids", "n_words", "bases", "terms", "counts", "postings"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids, lengths, positions, terms, known, size, base = [], [], [], [], dict(wanted or {}), 0, 0
        for batch in batches:
            id_type = pa.list_(batch.schema.field(0).type)
            keys = batch.column(0).to_pylist()
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                own = words(text)
                if wanted is None:
                    term = np.array([known.setdefault(w, len(known)) for w in own], np.int32)
                else:
                    term = np.fromiter(map(known.get, own, repeat(-1)), np.int32, len(own))
                at = np.flatnonzero(term >= 0).astype(np.int32)
                positions.append(at + base)
                terms.append(term[at])
                ids.append(keys[i])
                lengths.append(len(own))
                base += len(own) + GAP
                size += len(text or "")
                if size >= SHARD_BYTES:
                    yield shard(f"{part}-{made}", pa.array([ids], id_type), lengths, positions, terms, known)
                    made += 1
                    ids, lengths, positions, terms, known, size, base = [], [], [], [], dict(wanted or {}), 0, 0
        if ids:
            yield shard(f"{part}-{made}", pa.array([ids], id_type), lengths, positions, terms, known)

    return docs.select(id_col, text_col).mapInArrow(work, SHARD.format(id=kind))


def find(windows: Windows, frequency: np.ndarray, lists: dict[int, np.ndarray], slop: int = 0, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, start, place of the rarest term) of each occurrence, from the rarest term of each window to its most frequent.

    The positions of the rarest term, less its offset, are candidate starts; each further term keeps those
    where it stands at its own offset, or with slop at most so many words from there.
    """
    span = np.int64(1) << 32
    present = np.zeros(len(frequency) + 1, bool)
    present[list(lists)] = True
    present[-1] = True  # beyond the end of a short window
    row = np.flatnonzero(present[windows.term].all(1))
    if not len(row):
        return
    names = np.array(sorted(lists))
    sizes = np.array([len(lists[t]) for t in names])
    first = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate([lists[t] for t in names]).astype(np.int64)
    keys = np.repeat(np.arange(len(names), dtype=np.int64), sizes) * span + flat + GAP
    local = np.full(len(frequency) + 1, -1, np.int64)
    local[names] = np.arange(len(names))
    term = windows.term[row]
    cost = np.where(term >= 0, frequency[term], np.iinfo(np.int64).max)
    order = np.argsort(cost, axis=1, kind="stable")
    rare = local[term[np.arange(len(row)), order[:, 0]]]
    total = np.cumsum(sizes[rare] * (2 * slop + 1))
    for part in np.split(np.arange(len(row)), np.searchsorted(total, np.arange(most, total[-1], most))):
        if not len(part):
            continue
        n = sizes[rare[part]]
        which = np.repeat(part, n)
        place = flat[np.repeat(first[rare[part]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        start = place - order[which, 0]
        if slop:
            place, which, start = np.repeat(place, 2 * slop + 1), np.repeat(which, 2 * slop + 1), (start[:, None] + np.arange(-slop, slop + 1)).ravel()
        for k in range(1, term.shape[1]):
            at = order[which, k]
            own = local[term[which, at]]
            low = own * span + start + at - slop + GAP
            near = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
            kept = (term[which, at] < 0) | ((keys[near] >= low) & (keys[near] <= low + 2 * slop))
            which, start, place = which[kept], start[kept], place[kept]
        yield row[which], start, place


def search(index: DataFrame, windows: Windows, frequency: dict[str, int], slop: int = 0) -> DataFrame:
    """(shard, ordinal, id, n_words, hit array<int>, items array<string>) for each indexed document.

    hit has the document's words inside any occurrence, items the ids of the items that occur. With slop
    each word of a window may stand so many places off (proximity); hit is then the window's own stretch.
    """
    id_type = index.schema["ids"].dataType.elementType
    count = np.array([frequency.get(t.decode(), 0) for t in windows.terms] + [0], np.int64)
    number = {t.decode(): i for i, t in enumerate(windows.terms)}
    alive = ((count[windows.term] > 0) | (windows.term < 0)).all(1)
    windows = Windows(windows.terms, windows.term[alive], windows.item[alive], windows.item_ids)
    lengths = (windows.term >= 0).sum(1)
    sent = index.sparkSession.sparkContext.broadcast((windows, count[:-1], number, lengths))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, count, number, lengths = sent.value
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(k)[r] for k, name in enumerate(batch.schema.names)}
                n_words, bases = np.array(row["n_words"].as_py(), np.int64), np.array(row["bases"].as_py(), np.int64)
                at = np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(row["postings"].as_py()), "<i4"), dtype=np.int64)
                ends = np.cumsum([0, *row["counts"].as_py()])
                lists = {number[t]: at[s:e] for t, s, e in zip(row["terms"].as_py(), ends, ends[1:]) if t in number}
                hits: dict[int, list] = {}
                items: dict[int, set] = {}
                for which, start, place in find(windows, count, lists, slop):
                    doc = np.searchsorted(bases, place, "right") - 1
                    for w, s, d in zip(which.tolist(), start.tolist(), doc.tolist()):
                        hits.setdefault(d, []).append((max(s - bases[d], 0), min(s - bases[d] + lengths[w], n_words[d])))
                        items.setdefault(d, set()).add(windows.item[w])
                n = len(n_words)
                hit = [sorted({p for s, e in set(hits.get(d, ())) for p in range(s, e)}) for d in range(n)]
                found = [sorted(str(windows.item_ids[i]) for i in items.get(d, ())) for d in range(n)]
                columns = [pa.array([row["shard"].as_py()] * n), pa.array(range(n), pa.int32()), row["ids"].values, pa.array(n_words, pa.int64()), pa.array(hit, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "ordinal", "id", "n_words", "hit", "items"])

    return index.mapInArrow(work, f"shard string, ordinal int, id {id_type.simpleString()}, n_words long, hit array<int>, items array<string>")


def occurrences(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slop: int = 0) -> DataFrame:
    """(id, n_words, hit, items) for every document: exact phrases, or proximity matches with slop.

    The benchmark is the query set. Its size is measured first: beyond BLOCK_CHARS it is searched in
    blocks, each against an index of the terms that the block can ask for, and the answers of a
    document are united. Null texts have no words; items without words never occur; repeated rows keep
    their rows; an empty table gives no rows and an empty benchmark no hits.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-max(chars, 1) // BLOCK_CHARS)
    answers = []
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        windows = item_windows([tuple(r) for r in own.collect()])
        index = saved(build_index(docs, windows.terms, id_col, text_col), "token_index")
        pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("n"))
        frequency = {r["terms"]: r["n"] for r in pairs.collect()}  # at most the block's own terms
        answers.append(search(index, windows, frequency, slop))
    if blocks == 1:
        return answers[0].drop("shard", "ordinal")
    united = answers[0]
    for a in answers[1:]:
        united = united.unionByName(a)
    united = united.groupBy("shard", "ordinal", "id", "n_words").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return united.drop("shard", "ordinal")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    found = occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.size("hit").cast("long")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS k, least(len(w), 10) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
          FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS i FROM d, sizes)),
hit AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win ON win.k = g.k AND win.n = g.n),
per AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN its USING (doc_id)
"""
