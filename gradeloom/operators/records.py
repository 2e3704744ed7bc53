"""Versioned records: tables that change feeds and merges keep up to date, in buckets of their keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.sources.scratch import stored


def apply_feed(table: DataFrame, feed: DataFrame, key: str, version: str = "version", removed: str = "removed") -> DataFrame:
    """A table of versioned records after a batch of its change feed: of each key the latest version stays.

    The table keeps versions, and removed records as rows of their own (see present), so a later batch with an older
    version has no effect, and the order of batches none at all: of equal versions a removal precedes, then
    the greater record. Rows without a version precede all others; removed counts as false where it is null.
    A table without these columns holds records of no version.
    """
    own = table.withColumns({c: F.lit(None).cast(feed.schema[c].dataType) for c in (version, removed) if c not in table.columns})
    both = own.unionByName(feed.select(own.columns)).withColumn(removed, F.coalesce(removed, F.lit(False)))
    order = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), F.col(removed).desc(), F.struct(*sorted(set(own.columns) - {key, version, removed})).desc())
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def present(table: DataFrame, version: str = "version", removed: str = "removed") -> DataFrame:
    """The records of a versioned table that are not removed, without the two columns."""
    return table.where(~F.coalesce(removed, F.lit(False))).drop(version, removed)


@dataclass(frozen=True)
class Store:
    """A folder of versioned records (key, version, removed and others), partitioned by a hash of the key.

    A merge reads and rewrites the buckets of the keys that it changes and no other file. Their new rows are put
    together in the shared folder first, and a bucket is replaced as a whole. The number of buckets belongs to the
    folder: as many as keep a bucket at the size of a few files.
    """

    path: str
    key: str
    schema: str
    buckets: int = 64

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int"))

    def rows(self, spark: SparkSession) -> DataFrame:
        """All records with version, removed and bucket."""
        return spark.read.schema(f"{self.schema}, bucket INT").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        """The records that are not removed."""
        return present(self.rows(spark).drop("bucket"))

    def create(self, records: DataFrame) -> None:
        """Start the folder anew with these records."""
        self._write(self._bucketed(records), "overwrite")

    def merge(self, changes: DataFrame) -> list[int]:
        """Apply changed and removed records, whatever the order of merges; returns the buckets that were rewritten."""
        spark = changes.sparkSession
        batch = stored(self._bucketed(changes), "changes")
        touched = sorted(r["bucket"] for r in batch.select("bucket").distinct().collect())  # one number a bucket at most
        if touched:
            old = self.rows(spark).where(F.col("bucket").isin(touched))
            self._write(stored(apply_feed(old, batch, self.key), "merged"), "overwrite")
        return touched

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows.repartition("bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)


QUESTION = "struct<qid: BIGINT, num: INT, pos: INT, text: STRING, options: ARRAY<STRING>, answer: INT>"
PAPERS = f"paper_id BIGINT, title STRING, note STRING, key_source STRING, questions ARRAY<{QUESTION}>, version INT, removed BOOLEAN"


def paper_records(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """One record a paper: its entry (paper_id, title, note, key_source, version, removed) and its questions in order.

    Entry and questions are one row of a Store, so a merge commits both or none.
    """
    one = F.struct(*(F.col(c).cast(t).alias(c) for c, t in (("pos", "int"), ("qid", "long"), ("num", "int"), ("text", "string"), ("options", "array<string>"), ("answer", "int"))))
    each = questions.groupBy("paper_id").agg(F.array_sort(F.collect_list(one)).alias("q"))
    ordered = F.transform("q", lambda x: F.struct(*(x[c].alias(c) for c in ("qid", "num", "pos", "text", "options", "answer"))))
    rows = entries.join(each, "paper_id", "left").withColumn("questions", F.coalesce(ordered, F.array().cast(f"array<{QUESTION}>")))
    return rows.select("paper_id", "title", "note", "key_source", "questions", F.col("version").cast("int"), F.coalesce("removed", F.lit(False)).alias("removed"))


def paper_index(papers: DataFrame) -> DataFrame:
    """The index of a library: an entry for each paper, without its questions."""
    keyed = F.size(F.filter("questions", lambda q: q["answer"].isNotNull()))
    return papers.select("paper_id", "title", "note", "key_source", F.size("questions").alias("questions"), keyed.alias("keyed"))
