"""Document fingerprints: a canonical exact digest, with DataFrame and SQL functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import saved, table

#: Rows of a bucket in the id order, and the most buckets (both lists of borders are then short).
BUCKET_ROWS, MOST_BUCKETS = 1000, 65_536


def canonical(text: Column) -> Column:
    """Compatibility composition (NFKC) of the folded case, with runs of white space as one space, trimmed.

    ICU's static functions are called through SQL's reflect. Null counts as empty.
    """
    text = F.coalesce(text, F.lit(""))
    folded = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True))
    composed = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    other = r"\t-\r\u0085   "  # NFKC has turned the rest into spaces
    return F.trim(F.regexp_replace(composed, rf" [ {other}]+|[{other}][ {other}]*", " "))


def wide_hash(canon: Column) -> Column:
    """128 bits: two xxhash64 values with different beginnings."""
    return F.struct(F.xxhash64(F.lit(1), canon).alias("a"), F.xxhash64(F.lit(2), canon).alias("b"))


def hash_hex(h: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h["a"]), 16, "0"), F.lpad(F.hex(h["b"]), 16, "0")))


def with_fingerprint(df: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint column: equal canonical texts have equal fingerprints and only they.

    Rows are grouped by the wide hash and, inside equal buckets, by the canonical bytes; where a bucket
    holds more than one text, the later ones in byte order get their rank as a suffix. Groups of copies
    are summed before the shuffle, so one huge group is one row for each task. Null counts as empty,
    extra columns pass through, an empty table gives no rows.
    """
    canon = canonical(F.col(text_col))
    distinct = df.select(canon.alias("c")).withColumn("h", wide_hash(F.col("c"))).groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"))
    crowded = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h")
    rank = F.row_number().over(Window.partitionBy("h").orderBy("c"))
    later = distinct.join(crowded, "h", "left_semi").withColumn("_rank", rank).where("_rank > 1").select("h", "c", "_rank")
    later = later.withColumnsRenamed({"h": "_lh", "c": "_lc"})
    out = df.withColumn("_canon", canon).withColumn("_h", wide_hash(F.col("_canon")))
    out = out.join(later, (F.col("_h") == F.col("_lh")) & (F.col("_canon") == F.col("_lc")), "left")
    return out.withColumn(name, F.concat(hash_hex(F.col("_h")), F.when(F.col("_rank").isNotNull(), F.concat(F.lit("-"), "_rank")).otherwise(""))).drop("_canon", "_h", "_lh", "_lc", "_rank")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(id, text, next_text, and with hashed their wide hashes h, next_h): every row beside the one after it.

    The order is descending id, then text; after the last row comes the first. Rows are dealt into ranges
    of ids of like size, whose borders are percentiles of the ids, so no single task sorts all. The first
    row of each range is also put at the end of the range above as a guest. Null ids come last.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = docs.select(F.col(id_col).alias("id"))
    n = ids.count()
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    borders = []
    if buckets > 1:
        at = [i / buckets for i in range(1, buckets)]
        borders = sorted(set(ids.agg(F.percentile_approx("id", at, max(10_000, 10 * buckets)).alias("p")).first()["p"] or []))
    step = max(1, int(len(borders) ** 0.5))
    fine = [borders[i : i + step] for i in range(0, len(borders), step)]
    if borders:
        fines = F.from_json(F.lit(json.dumps(fine)), "array<array<bigint>>")
        firsts = F.from_json(F.lit(json.dumps([f[0] for f in fine])), "array<bigint>")
        group = F.size(F.filter(firsts, lambda b: b <= F.col("id")))
        within = F.size(F.filter(F.element_at(fines, group), lambda b: b <= F.col("id")))
        bucket = F.when(F.col("id").isNull(), -1).when(F.col("id") < F.lit(borders[0]), 0).otherwise((group - 1) * step + within)
    else:
        bucket = F.when(F.col("id").isNull(), -1).otherwise(0)
    rows, ids = rows.withColumn("bucket", bucket), ids.withColumn("bucket", bucket)
    heads = ids.groupBy("bucket").agg(F.max("id").alias("top"))
    everything = Window.orderBy("bucket")  # a row for each bucket
    own = F.struct("bucket", "top")
    below = F.coalesce(F.lag(own).over(everything), F.last(own).over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select(F.col("bucket").alias("host"), below.alias("below")).select("host", F.col("below.bucket").alias("from"), "below.top")
    guests = rows.join(F.broadcast(heads), (rows["bucket"] == heads["from"]) & rows["id"].eqNullSafe(heads["top"]))
    guests = guests.groupBy("host", "id").agg(F.min("text").alias("text")).select("id", "text", F.col("host").alias("bucket"))
    both = rows.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1)))
    made = ["h"] if hashed else []
    if hashed:
        both = both.withColumn("canon", canonical(F.col("text"))).withColumn("h", wide_hash(F.col("canon"))).drop("canon")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("id").desc_nulls_last(), "text")
    both = both.withColumns({f"next_{c}": F.lead(c).over(order) for c in ["text", *made]})
    return both.where("guest = 0").select(F.col("id").alias(id_col), "text", "next_text", *made, *(f"next_{c}" for c in made))


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document.

    The digest is exact: likeness is 1 where canonical texts are equal byte by byte and else 0. Texts that
    share a wide hash are compared by their bytes before fingerprints count as equal.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_next(docs, hashed=True)
    n = F.char_length("text")
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": F.concat(F.expr("substring(text, 1, char_length(text) - char_length(text) div 2)"), F.expr("substring(next_text, 1, char_length(text) div 2)"))})
    rows = rows.withColumn("edited_canon", canonical(F.col("edited"))).withColumn("edited_h", wide_hash(F.col("edited_canon"))).drop("edited_canon")

    def like(h: str, other: str) -> Column:
        same = (F.col("h") == F.col(h)) & (canonical(F.col("text")) == canonical(F.col(other)))
        return F.when(F.col("h") != F.col(h), 0.0).otherwise(same.cast("double"))

    rows = rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "h", "edited_h",
        like("edited_h", "edited").alias("near_edited"), like("next_h", "next_text").alias("near_next"),
    )
    rows = saved(rows, "fingerprints")
    # byte comparison inside equal buckets: only hashes that occur more than once need their texts again
    shared = rows.select("h").union(rows.select(F.col("edited_h").alias("h"))).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    texts = docs.select(canonical(F.col("text")).alias("c")).withColumn("h", wide_hash(F.col("c"))).join(shared, "h", "left_semi").groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"))
    crowded = texts.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    if crowded.isEmpty():
        later = None
    else:
        rank = F.row_number().over(Window.partitionBy("h").orderBy("c"))
        later = texts.join(crowded.select("h"), "h", "left_semi").withColumn("rank", rank).where("rank > 1").select("h", "c", "rank")
        later = docs.withColumn("c", canonical(F.col("text"))).withColumn("h", wide_hash(F.col("c"))).join(later, ["h", "c"]).select("doc_id", "h", "rank").distinct()
        rows = rows.join(later, ["doc_id", "h"], "left")
    suffix = F.lit("") if later is None else F.coalesce(F.concat(F.lit("-"), "rank"), F.lit(""))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.concat(hash_hex(F.col("h")), suffix).alias("fingerprint"),
        F.concat(hash_hex(F.col("edited_h")), F.when(F.col("near_edited") == 1, suffix).otherwise("")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
