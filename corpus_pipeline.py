"""From raw documents to token ids: quality, near-duplicates, benchmark leaks, personal data, encoding.

Each stage reads what the last one wrote, decides on all of it, and returns rows for the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import bpe, decontamination, near_dups, pii
from gradeloom.llm import quality as quality_model
from gradeloom.llm.common import shared_dir, table


#: Rows of an Arrow batch. By default these are 10,000, and an executor holds a batch of texts several times over, beside a full heap.
BATCH = 1_000


def _stage(decide: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose tasks get BATCH rows at a time; the caller runs what it returns, so the session keeps the setting."""

    @wraps(decide)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
        return decide(spark, docs, sf_dir)

    return stage


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _key, by which decisions on rows are joined back: the id and a hash of the text.

    So rows that share an id, or have none, are judged one by one unless their texts are the same, too. In
    the order of keys, rows without an id come last.
    """
    return docs.withColumn("_key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text")))


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, trained on the labelled rows among docs, does not reject.

    A null text is judged as an empty one; repeated rows and ids are judged each; long texts are judged whole;
    other columns stay as they are; an empty table gives no rows.
    """
    return quality_model.keep_good(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: that of least doc_id, of several with it that of least text hash.

    Rows with the same id and text are one. Null counts as the empty text, and texts without words are alike
    only if equal; rows without an id are rows as any other, but stay only for classes in which no row has
    one. Long texts are compared whole; other columns stay as they are; an empty table gives no rows.
    """
    rows = _keyed(docs)
    classes = near_dups.near_classes(rows, "_key")
    gone = classes.where("id != class_id").select(F.col("id").alias("_key")).distinct()
    kept = rows.join(gone, "_key", "left_anti")
    again = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_key")
    if again.isEmpty():
        return kept.select(docs.columns)
    one = kept.join(again, "_key", "left_semi").groupBy("_key").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return one.unionByName(kept.join(again, "_key", "left_anti").select(docs.columns))


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any benchmark passage.

    Null texts and texts without words have none and stay; repeated rows and ids are judged each; long texts
    are searched whole; other columns stay as they are; an empty table gives no rows.
    """
    rows = _keyed(docs)
    found = decontamination.occurrences(rows, table(spark, sf_dir, "benchmark"), id_col="_key")
    gone = found.where(F.size("hit") > 0).select(F.col("id").alias("_key")).distinct()
    return rows.join(gone, "_key", "left_anti").select(docs.columns)


@_stage
def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind in brackets; n_chars is that of the new text.

    Null texts stay null, with a null n_chars, and empty ones empty; repeated rows and ids keep their rows; long
    texts are taken whole; other columns stay as they are; an empty table gives no rows.
    """
    return pii.redact(docs, pii.train(docs)).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row and the digests of ids and decoded bytes; null and empty texts have no ids.

    Repeated rows and ids keep their rows; long texts are encoded whole; an empty table gives no rows.
    """
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("personal data", private_data),
    ("byte-level BPE", encode),
]

#: No stage but the third can be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/tables/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
