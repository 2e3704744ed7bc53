"""Exam tables made from the star-schema tables, row by row and at any scale.

questions from part, attempts from orders, attempt items from lineitem, attempt events from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEM = "array<struct<type:string,text:string,rows:array<array<string>>>>"
TEMPLATES = (
    "Given below are two statements. Assertion (A): the {n} is light. Reason (R): it is {b}.",
    "Match List-I with List-II for {n} and {b}.",
    "Arrange the following in chronological order: {n}, {b}",
    "How many pairs given above are correctly matched for {n}",
    "Which of the following statements about {n} is correct?",
    "Who made the {n} of {b}?",
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, qid, num, pos, text, stem, options, answer: fifty questions of a paper."""
    p = read(spark, sf_dir, "part")
    text = F.lit(None).cast("string")
    for i, t in enumerate(TEMPLATES):
        said = F.replace(F.replace(F.lit(t), F.lit("{n}"), F.col("p_name")), F.lit("{b}"), F.col("p_brand"))
        text = F.when(F.col("p_size") % 6 == i, said).otherwise(text)
    rows = p.select(
        F.floor(F.col("p_partkey") / 50).alias("paper_id"), F.col("p_partkey").alias("qid"),
        (F.col("p_partkey") % 50 + 1).cast("int").alias("num"), (F.col("p_partkey") % 50).cast("int").alias("pos"), text.alias("text"),
        F.array("p_brand", "p_type", "p_name", F.concat("p_brand", F.lit(" "), "p_type")).alias("options"),
        F.when(F.col("p_size") % 5 != 4, F.col("p_size") % 5).alias("answer"),
    )
    numbered = F.when(F.col("qid") % 7 == 3, F.array("text", F.concat(F.lit("1. "), F.get("options", F.lit(2)))))  # every seventh question has a numbered paragraph, too
    return rows.withColumn("stem", F.transform(F.coalesce(numbered, F.array("text")), lambda p: F.struct(F.lit("p").alias("type"), p.alias("text"), F.lit(None).cast("array<array<string>>").alias("rows"))).cast(STEM))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attempt_id, student_id, status, started_at, submitted_at, duration_sec, time_used_sec, plus, minus."""
    o = read(spark, sf_dir, "orders")
    key, start = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    done = F.col("o_orderstatus") == "F"
    return o.select(
        key.alias("attempt_id"), F.col("o_custkey").alias("student_id"),
        F.when(done, "submitted").when(F.col("o_orderstatus") == "O", "in-progress").otherwise("scheduled").alias("status"),
        start.alias("started_at"), F.when(done, F.timestamp_add("SECOND", (key % 7000).cast("int"), start)).alias("submitted_at"),
        (key % 4 * 3600).cast("int").alias("duration_sec"), F.when(key % 3 != 0, (key % 5000).cast("int")).alias("time_used_sec"),
        F.lit(2.0).alias("plus"), F.lit(0.66).alias("minus"),
    )


def attempt_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attempt_id, idx, qid, resp, marked, visited, time_s, changes: one row for each question of an attempt."""
    raw = read(spark, sf_dir, "lineitem")
    first = Window.partitionBy("l_orderkey", "l_partkey").orderBy("l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    one = raw.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag", "l_linestatus")
    one = one.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return one.select(
        F.col("l_orderkey").alias("attempt_id"), (F.row_number().over(order) - 1).alias("idx"), F.col("l_partkey").alias("qid"),
        F.when(F.col("l_suppkey") % 5 != 4, (F.col("l_suppkey") % 5).cast("int")).alias("resp"), (F.col("l_returnflag") == "R").alias("marked"),
        (F.col("l_linestatus") == "F").alias("visited"), (F.col("l_quantity") * 5).alias("time_s"), (F.col("l_linenumber") % 3).alias("changes"),
    )


def attempt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attempt_id, event_time, seq, kind, qid, option: a log of ten questions for each user."""
    e = read(spark, sf_dir, "events")
    kinds = F.create_map(*map(F.lit, ("click", "pick", "error", "clear", "signup", "mark", "purchase", "save", "view", "tick")))
    kind = kinds[F.col("event_type")]
    return e.select(
        F.col("user_id").alias("attempt_id"), F.col("ts").cast("timestamp_ntz").alias("event_time"), F.col("event_id").alias("seq"), kind.alias("kind"),
        (F.get_json_object("props", "$.k").cast("int") % 10).alias("qid"), F.when(kind == "pick", (F.floor("value") % 4).cast("int")).alias("option"),
    )


#: The same tables for DuckDB, to be put before a query.
SQL = {
    "questions": """questions AS (SELECT p_partkey // 50 AS paper_id, p_partkey AS qid, CAST(p_partkey % 50 + 1 AS INT) AS num, CAST(p_partkey % 50 AS INT) AS pos,
  CASE p_size % 6 """
    + " ".join(f"WHEN {i} THEN replace(replace('{t}', '{{n}}', p_name), '{{b}}', p_brand)" for i, t in enumerate(TEMPLATES))
    + """ END AS text, CASE WHEN p_partkey % 7 = 3 THEN [text, '1. ' || p_name] ELSE [text] END AS paragraphs, [p_brand, p_type, p_name, p_brand || ' ' || p_type] AS options,
  CASE WHEN p_size % 5 <> 4 THEN p_size % 5 END AS answer FROM part)""",
    "attempts": """attempts AS (SELECT o_orderkey AS attempt_id, o_custkey AS student_id,
  CASE o_orderstatus WHEN 'F' THEN 'submitted' WHEN 'O' THEN 'in-progress' ELSE 'scheduled' END AS status, o_orderdate AS started_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_seconds(o_orderkey % 7000) END AS submitted_at, CAST(o_orderkey % 4 * 3600 AS INT) AS duration_sec,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 5000 AS INT) END AS time_used_sec, 2.0::DOUBLE AS plus, 0.66::DOUBLE AS minus FROM orders)""",
    "items": """items AS (SELECT l_orderkey AS attempt_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS idx, l_partkey AS qid,
  CASE WHEN l_suppkey % 5 <> 4 THEN l_suppkey % 5 END AS resp, l_returnflag = 'R' AS marked, l_linestatus = 'F' AS visited, l_quantity * 5 AS time_s, l_linenumber % 3 AS changes
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n FROM lineitem) WHERE n = 1)""",
    "log": """log AS (SELECT user_id AS attempt_id, ts AS event_time, event_id AS seq,
  CASE event_type WHEN 'click' THEN 'pick' WHEN 'error' THEN 'clear' WHEN 'signup' THEN 'mark' WHEN 'purchase' THEN 'save' WHEN 'view' THEN 'tick' END AS kind,
  CAST(json_extract_string(props, '$.k') AS INT) % 10 AS qid, CASE WHEN event_type = 'click' THEN CAST(floor(value) AS INT) % 4 END AS option FROM events)""",
}


def with_tables(*names: str) -> str:
    """The WITH clause of a DuckDB query over these tables, open for more."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
