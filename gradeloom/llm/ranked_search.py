"""Ranked lexical search: an inverted index in shards of documents, searched with MaxScore."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import saved, table
from gradeloom.llm.pieces import slices
from gradeloom.llm.words import words

#: Bytes of text in a shard (one document at least), characters of items in a block of queries, results an item.
SHARD_BYTES, BLOCK_CHARS, BEST = 16_000_000, 1_000_000, 10


def _shard(part: pa.RecordBatch, name: str) -> pa.RecordBatch:
    """The rows of one shard: its header (no term; lengths and ids of its documents) and its posting lists."""
    part = part.take(pc.sort_indices(part.column(0)))  # places follow ids, those without an id come last
    split = [words(t) for t in part.column(1).to_pylist()]
    lengths = np.array([len(w) for w in split], np.int64)
    coded = pa.array([w for s in split for w in s], pa.binary()).dictionary_encode()
    key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(split) + np.repeat(np.arange(len(split)), lengths), return_counts=True)
    term, place = np.divmod(key, max(len(split), 1))
    df = np.bincount(term, minlength=len(coded.dictionary))
    at = 4 * np.concatenate([[0, 0], np.cumsum(df)])  # the header has no places ...
    counts = np.concatenate([lengths, tf]).astype("<i4")  # ... but its counts are lengths
    n = len(df) + 1
    blob = lambda offsets, raw: pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
    first = lambda value, kind: pa.array([value, *[None] * (n - 1)], kind)
    columns = [
        pa.array([name] * n), pa.concat_arrays([pa.array([None], pa.binary()), coded.dictionary]), pa.array([None, *df.tolist()], pa.int64()),
        blob(at, place.astype("<i4").tobytes()), blob(np.concatenate([[0], 4 * len(split) + at[1:]]), counts.tobytes()),
        first(len(split), pa.int64()), first(int((lengths > 0).sum()), pa.int64()), first(int(lengths.sum()), pa.int64()),
        pa.ListArray.from_arrays(pa.array([0] + [len(split)] * n, pa.int32()), part.column(0)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "term", "df", "places", "counts", "n_docs", "n_worded", "n_terms", "ids"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The inverted index of whole texts, a row for each shard and term, and a header row for each shard.

    A shard is neighbouring rows with about shard_bytes of text, so its lists are bounded whatever the
    corpus. It is worth a table: it serves any number of searches. Words are those of words().
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for part in slices(batch, text_col, shard_bytes):
                yield _shard(part, f"{TaskContext.get().partitionId()}-{number}")
                number += 1

    rows = docs.select(id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(work, f"shard string, term binary, df long, places binary, counts binary, n_docs long, n_worded long, n_terms long, ids array<{kind}>")


def impacts(tf: np.ndarray, m: np.ndarray, weight: int) -> np.ndarray:
    """What a term adds to the score of each document of its list."""
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def max_score(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, best: int = BEST) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the best documents, equal scores by place, from lists of (places, impacts), none empty.

    Lists stand in the order of their upper bounds, the greatest impact in each. They are essential, and
    read in full, as long as the bounds of all from there on could lift a document not seen yet among the
    best; of the rest, only the documents are looked up that can still qualify.
    """
    bounds = [int(c.max()) for _, c in lists]
    order = sorted(range(len(lists)), key=lambda i: -bounds[i])
    rest = np.concatenate([np.cumsum([bounds[i] for i in order][::-1])[::-1], [0]]) if lists else np.zeros(1, np.int64)
    score, least, turn = np.zeros(n_docs, np.int64), 0, 0
    while turn < len(order) and rest[turn] >= least:
        places, own = lists[order[turn]]
        score[places] += own
        turn += 1
        if n_docs > best:
            least = int(np.partition(score, -best)[-best])
    found = np.flatnonzero((score > 0) & (score + rest[turn] >= least))
    score = score[found]
    for i in order[turn:]:
        places, own = lists[i]
        at = np.minimum(np.searchsorted(places, found), len(places) - 1)
        score = score + np.where(places[at] == found, own[at], 0)
        turn += 1
        if len(found) > best:
            least = max(least, int(np.partition(score, -best)[-best]))
        can = score + rest[turn] >= least
        found, score = found[can], score[can]
    top = np.lexsort((found, -score))[:best]
    return found[top], score[top]


def _searched(index: DataFrame, items: list[tuple], docs: int, terms: int, best: int) -> DataFrame:
    """(number, id, score): the best of each shard for each of a block of items (item, text)."""
    asked = [Counter(words(text)) for _, text in items]
    known = sorted({t for a in asked for t in a})
    spark = index.sparkSession
    wanted = spark.createDataFrame([(t, True) for t in known], "term binary, wanted boolean")
    rows = index.join(F.broadcast(wanted), "term", "left").where("wanted OR term IS NULL")  # lists, and headers, which have no term
    frequency = {bytes(r["term"]): r["df"] for r in rows.where("wanted").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # at most the block's own terms
    weight = {t: floor(1000 * log((2 * docs + 2) / (2 * df + 1))) for t, df in frequency.items()}
    sent = spark.sparkContext.broadcast((asked, weight))

    def work(shard: pa.Table) -> pa.Table:
        asked, weight = sent.value
        header = shard.filter(pc.is_null(shard["term"]))
        ids, length = header["ids"].combine_chunks().values, np.frombuffer(header["counts"][0].as_py(), "<i4").astype(np.int64)
        m = 25 + 75 * length * docs // terms
        own = {}
        for term, places, counts in zip(shard["term"].to_pylist(), shard["places"].to_pylist(), shard["counts"].to_pylist(), strict=True):
            if term is not None and weight[term]:
                place, tf = np.frombuffer(places, "<i4").astype(np.int64), np.frombuffer(counts, "<i4").astype(np.int64)
                own[term] = place, impacts(tf, m[place], weight[term])
        numbers, places, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for number, terms_of in enumerate(asked):
            lists = [(own[t][0], n * own[t][1]) for t, n in terms_of.items() if t in own]
            place, score = max_score(lists, len(length), best)
            numbers.append(np.full(len(place), number))
            places.append(place)
            scores.append(score)
        columns = [pa.array(np.concatenate(numbers), pa.int32()), ids.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(scores))]
        return pa.Table.from_arrays(columns, names=["number", "id", "score"])

    kind = index.schema["ids"].dataType.elementType.simpleString()
    return rows.select("shard", "term", "places", "counts", "ids").groupBy("shard").applyInArrow(work, f"number int, id {kind}, score long")


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", item_text: str = "text", best: int = BEST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item, rank, id, score): the best documents of an index for each item; index is a table from build_index().

    A term's weight falls with the documents that hold it, and its share in the score saturates with its
    occurrences, sooner in short documents; all is whole numbers, so ranks are exact. Equal scores are ranked
    by id, documents without an id last; only scores above 0 count. Items are queries: they are measured
    first, and searched in blocks of about block_chars. Items without a term, or none of whose terms occur,
    have no rows; of equal rows of items one is searched, different texts of one item each; repeated
    documents are ranked each; null texts have no terms; other columns are ignored; empty tables give no rows.
    """
    spark = index.sparkSession
    queries = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL").distinct()
    chars = queries.agg(F.sum(F.length("text"))).first()[0] or 0
    total = index.where("term IS NULL").agg(F.sum("n_worded").alias("docs"), F.sum("n_terms").alias("terms")).first()
    types = f"item {queries.schema['item'].dataType.simpleString()}, rank int, id {index.schema['ids'].dataType.elementType.simpleString()}, score long"
    if not total["terms"] or not chars:
        return spark.createDataFrame([], types)
    blocks, answers = -(-chars // block_chars), []
    for b in range(blocks):
        block = [tuple(r) for r in (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)).collect()]
        if not block:
            continue
        found = _searched(index, block, total["docs"], total["terms"], best)
        order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], f"number int, {types.split(',')[0]}")
        answers.append(ranked.join(F.broadcast(names), "number").select("item", "rank", "id", "score"))
    return reduce(DataFrame.unionByName, answers)


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    index = saved(build_index(table(spark, sf_dir, "documents")), "ranked_index")
    found = search(index, table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
m AS (SELECT doc_id, 100 - 75 + (75 * len(w) * docs) // terms AS m FROM d, s WHERE len(w) > 0),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY ALL),
q AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest(w) AS t FROM b) GROUP BY ALL),
wt AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), s),
sc AS (SELECT item_id, doc_id, sum(q * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN tf USING (t) JOIN wt USING (t) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM sc WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
