"""Registered queries on attempts, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions.numbers import clock, half_up, minutes_text
from gradeloom.functions.text import numbered_paragraph, question_type, title_from_file
from gradeloom.operators import scoring as S
from gradeloom.sources import exam_tables as T
from gradeloom.sources.exam_tables import with_tables
from gradeloom.sources.scratch import stored


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.score_rows(T.attempt_items(spark, sf_dir), T.questions(spark, sf_dir))


ROWS = with_tables("questions", "attempts", "items") + """,
typed AS (SELECT qid, answer, CASE
  WHEN regexp_matches(text, '(?i)assertion\\s*\\(?a\\)?') AND regexp_matches(text, '(?i)reason\\s*\\(?r\\)?') THEN 'Assertion and reason'
  WHEN regexp_matches(text, '(?i)match\\s+list|list\\s*[-–]?\\s*i\\b.*list\\s*[-–]?\\s*ii') THEN 'Match the lists'
  WHEN regexp_matches(text, '(?i)chronolog|arrange|correct\\s+order|sequence') THEN 'Order and chronology'
  WHEN regexp_matches(text, '(?i)pairs?\\b.*\\bmatched') THEN 'Matched pairs'
  WHEN regexp_matches(text, '(?i)statements?\\b') OR len(list_filter(paragraphs, lambda p: regexp_matches(p, '^[0-9]\\.\\s'))) > 0 THEN 'Statements' ELSE 'Direct question' END AS type FROM questions),
r AS (SELECT i.attempt_id, i.idx, i.qid, i.resp, i.marked, i.visited, CAST(floor(i.time_s + 0.5) AS BIGINT) AS time, i.changes, t.type,
  CASE WHEN t.answer IS NULL THEN 'unscored' WHEN i.resp IS NULL THEN 'skipped' WHEN i.resp = t.answer THEN 'correct' ELSE 'wrong' END AS status
  FROM items i JOIN typed t USING (qid))"""

TOTALS = ROWS + """,
c AS (SELECT attempt_id, count_if(status = 'correct') AS correct, count_if(status = 'wrong') AS wrong, count_if(status = 'skipped') AS skipped,
  count_if(status = 'unscored') AS unscored, count_if(resp IS NOT NULL) AS attempted FROM r GROUP BY attempt_id),
t AS (SELECT c.*, floor((correct * plus - wrong * minus) * 100 + 0.5) / 100 AS score, floor((correct + wrong + skipped) * plus * 100 + 0.5) / 100 AS max,
  CASE WHEN correct + wrong > 0 THEN CAST(floor(correct::DOUBLE / (correct + wrong) * 100 + 0.5) AS BIGINT) END AS accuracy,
  floor(correct * plus * 100 + 0.5) / 100 AS gained, floor(wrong * minus * 100 + 0.5) / 100 AS lost FROM c JOIN attempts USING (attempt_id))"""


def score_attempts(spark, sf_dir):
    """Counts, score, maximum, accuracy and percent of every attempt."""
    return S.totals(rows(spark, sf_dir), T.attempts(spark, sf_dir))


def rescored_attempts(spark, sf_dir):
    """score_attempts after one question in 97 got another answer and one in 89 was removed: stored totals, mended where needed."""
    before = T.questions(spark, sf_dir)
    other = F.when(F.col("qid") % 97 == 5, F.when(F.col("answer").isNull(), 2).otherwise((F.col("answer") + 1) % 4)).otherwise(F.col("answer"))
    after = before.withColumn("answer", other.cast(before.schema["answer"].dataType)).where("qid % 89 != 7")
    totals = stored(score_attempts(spark, sf_dir), "totals")
    return S.rescore(totals, T.attempt_items(spark, sf_dir), T.attempts(spark, sf_dir), before, after)


def report_time_review(spark, sf_dir):
    """Time, marked, changed and unvisited statistics of every attempt."""
    return S.time_and_review(rows(spark, sf_dir), T.attempts(spark, sf_dir))


def report_by_type(spark, sf_dir):
    """Results of every attempt by question type."""
    return S.by_type(rows(spark, sf_dir))


def slowest_questions(spark, sf_dir):
    """Five slowest questions of every attempt."""
    return S.slowest(rows(spark, sf_dir))


def attempt_history(spark, sf_dir):
    """Every student's submitted attempts, scored anew with the current key."""
    return S.history(score_attempts(spark, sf_dir), T.attempts(spark, sf_dir))


def latest_attempts(spark, sf_dir):
    """Four latest submitted attempts of every student."""
    return S.latest(score_attempts(spark, sf_dir), T.attempts(spark, sf_dir))


def live_attempts(spark, sf_dir):
    """First running and all scheduled attempts of every student."""
    return S.live(T.attempts(spark, sf_dir))


def palette_counts(spark, sf_dir):
    """Question palette of every attempt."""
    return S.palette(T.attempt_items(spark, sf_dir))


def review_wrong(spark, sf_dir):
    """Wrong answers by test order and by time."""
    return S.review(rows(spark, sf_dir), "wrong")


def review_changed(spark, sf_dir):
    """Changed answers by test order and by time."""
    return S.review(rows(spark, sf_dir), "changed")


def shuffled_order(spark, sf_dir):
    """A seeded new order of every attempt's questions."""
    return S.shuffled(T.attempt_items(spark, sf_dir), "s1")


def question_types(spark, sf_dir):
    """Style of every question."""
    return T.questions(spark, sf_dir).select("qid", question_type(F.col("text"), numbered_paragraph(F.col("stem"))).alias("type"))


def scalar_formats(spark, sf_dir):
    """Rounding, clock and duration texts over every order, and a title from its priority as a file name."""
    o = T.read(spark, sf_dir, "orders")
    sec = F.col("o_orderkey") % 20_000 + 0.5
    return o.select(
        "o_orderkey", half_up(F.col("o_totalprice") - 100_000).cast("double").alias("rounded"), clock(sec).alias("clock"), minutes_text(sec).alias("duration"),
        title_from_file(F.concat(F.col("o_orderpriority"), F.lit("__paper \u00a0\u2003 x.PDF"))).alias("title"), title_from_file(F.lit("_ .pdf")).alias("untitled"),
    )


QUERIES = {
    f.__name__: f for f in (score_attempts, rescored_attempts, report_time_review, report_by_type, slowest_questions, attempt_history, latest_attempts, live_attempts, palette_counts, review_wrong, review_changed, shuffled_order, question_types, scalar_formats)
}

_REVIEW = ROWS + """ SELECT attempt_id, qid, status, time, row_number() OVER (PARTITION BY attempt_id ORDER BY idx) AS by_order,
  row_number() OVER (PARTITION BY attempt_id ORDER BY time DESC, idx) AS by_time FROM r WHERE """

_AFTER = TOTALS.replace("typed AS (SELECT qid, answer,", "typed AS (SELECT qid, CASE WHEN qid % 97 = 5 THEN CASE WHEN answer IS NULL THEN 2 ELSE (answer + 1) % 4 END ELSE answer END AS answer,").replace(
    "AS type FROM questions)", "AS type FROM questions WHERE qid % 89 <> 7)")

SQL = {
    "rescored_attempts": _AFTER + " SELECT *, CASE WHEN max <> 0 THEN floor(score / max * 1000 + 0.5) / 10 END AS percent FROM t",
    "score_attempts": TOTALS + " SELECT *, CASE WHEN max <> 0 THEN floor(score / max * 1000 + 0.5) / 10 END AS percent FROM t",
    "report_time_review": ROWS + """ SELECT attempt_id, bool_or(time > 0) AS tracked, CAST(floor(avg(time) FILTER (resp IS NOT NULL) + 0.5) AS BIGINT) AS per_answered,
  CAST(floor(avg(time) FILTER (r.status = 'correct') + 0.5) AS BIGINT) AS per_correct, CAST(floor(avg(time) FILTER (r.status = 'wrong') + 0.5) AS BIGINT) AS per_wrong, count_if(time > 120) AS over_2min,
  greatest(0, max(time)) AS max_time, count_if(marked) AS marked_total, count_if(marked AND r.status = 'correct') AS marked_correct, count_if(marked AND r.status = 'wrong') AS marked_wrong,
  count_if(marked AND resp IS NULL) AS marked_blank, count_if(changes > 0) AS changed_total, count_if(changes > 0 AND r.status = 'correct') AS changed_correct,
  count_if(changes > 0 AND r.status = 'wrong') AS changed_wrong, count_if(NOT visited) AS not_visited,
  any_value(coalesce(time_used_sec, CAST(floor(epoch(submitted_at - started_at) + 0.5) AS BIGINT))) AS time_used FROM r JOIN attempts USING (attempt_id) GROUP BY attempt_id""",
    "report_by_type": ROWS + """, g AS (SELECT attempt_id, type, count(*) AS total, count_if(status = 'correct') AS correct, count_if(status = 'wrong') AS wrong, count_if(status = 'skipped') AS skipped,
  count_if(status = 'unscored') AS unscored, CAST(floor(sum(time) / count(*) + 0.5) AS BIGINT) AS avg_time, min(idx) AS f FROM r GROUP BY attempt_id, type)
  SELECT * EXCLUDE (f), CASE WHEN correct + wrong > 0 THEN CAST(floor(correct::DOUBLE / (correct + wrong) * 100 + 0.5) AS BIGINT) END AS accuracy, row_number() OVER (PARTITION BY attempt_id ORDER BY total DESC, f) AS place FROM g""",
    "slowest_questions": ROWS + """ SELECT attempt_id, row_number() OVER (PARTITION BY attempt_id ORDER BY time DESC, idx) AS place, qid, idx, time FROM r WHERE time > 0
  QUALIFY place <= 5""",
    "attempt_history": TOTALS + """ SELECT student_id, attempt_id, submitted_at, score, max, accuracy, attempted, time_used_sec, row_number() OVER (PARTITION BY student_id ORDER BY submitted_at, attempt_id) AS number,
  row_number() OVER (PARTITION BY student_id ORDER BY submitted_at DESC, attempt_id DESC) AS from_last FROM t JOIN attempts USING (attempt_id) WHERE status = 'submitted'""",
    "latest_attempts": TOTALS + """, few AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY submitted_at DESC, attempt_id DESC) AS place FROM attempts WHERE status = 'submitted')
  SELECT student_id, place, attempt_id, score, max FROM few JOIN t USING (attempt_id) WHERE place <= 4""",
    "live_attempts": with_tables("attempts") + """ SELECT student_id, status, row_number() OVER (PARTITION BY student_id, status ORDER BY started_at NULLS FIRST, attempt_id) AS place, attempt_id, started_at
  FROM attempts WHERE status IN ('in-progress', 'scheduled') QUALIFY status = 'scheduled' OR place = 1""",
    "palette_counts": with_tables("items") + """ SELECT attempt_id, count_if(NOT marked AND resp IS NOT NULL) AS done, count_if(NOT marked AND resp IS NULL AND visited) AS seen,
  count_if(NOT marked AND resp IS NULL AND NOT visited) AS idle, count_if(marked AND resp IS NULL) AS mark, count_if(marked AND resp IS NOT NULL) AS markdone FROM items GROUP BY attempt_id""",
    "review_wrong": _REVIEW + "status = 'wrong'",
    "review_changed": _REVIEW + "changes > 0",
    "shuffled_order": with_tables("items") + " SELECT attempt_id, qid, row_number() OVER (PARTITION BY attempt_id ORDER BY md5('s1|' || attempt_id || '|' || qid), qid) - 1 AS place FROM items",
    "question_types": ROWS + " SELECT qid, type FROM typed",
    "scalar_formats": """WITH s AS (SELECT *, o_orderkey % 20000 + 1 AS sec, CAST(floor((o_orderkey % 20000 + 0.5) / 60 + 0.5) AS BIGINT) AS m FROM orders)
  SELECT o_orderkey, floor(o_totalprice - 100000 + 0.5) AS rounded,
  CASE WHEN sec >= 3600 THEN (sec // 3600) || ':' ELSE '' END || lpad(CAST(sec // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(sec % 60 AS VARCHAR), 2, '0') AS clock,
  CASE WHEN m < 60 THEN m || ' min' WHEN m % 60 = 0 THEN (m // 60) || ' h' ELSE (m // 60) || ' h ' || (m % 60) || ' min' END AS duration,
  o_orderpriority || ' paper x' AS title, 'Untitled test' AS untitled FROM s""",
}
