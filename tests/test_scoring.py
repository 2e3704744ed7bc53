"""Scores and report statistics of a small attempt, by hand."""

from pyspark.sql import functions as F

from gradeloom.functions import numbers, text
from gradeloom.operators import scoring as S

QUESTIONS = [
    ("q1", 0, "Given below are two statements. Assertion (A): x. Reason (R): y."),
    ("q2", 1, "Match List-I with List-II and select the correct answer."),
    ("q3", 2, "Which of the following statements is/are correct?"),
    ("q4", 3, "Who wrote Gitanjali?"),
    ("q5", None, "Arrange the following in chronological order."),
]
ITEMS = [
    ("a1", 0, "q1", 0, False, True, 30.0, 0), ("a1", 1, "q2", 3, True, True, 150.0, 1), ("a1", 2, "q3", None, True, True, 10.0, 0),
    ("a1", 3, "q4", None, False, False, None, None), ("a1", 4, "q5", 1, False, True, 20.0, 0), ("a1", 5, "gone", 1, False, True, 99.0, 0),
]


def frames(spark):
    q = spark.createDataFrame(QUESTIONS, "qid string, answer int, text string")
    i = spark.createDataFrame(ITEMS, "attempt_id string, idx int, qid string, resp int, marked boolean, visited boolean, time_s double, changes int")
    a = spark.createDataFrame([("a1", "s", "submitted", 2.0, 0.66, 300)], "attempt_id string, student_id string, status string, plus double, minus double, time_used_sec int")
    a = a.withColumns({"started_at": F.lit("2024-01-01").cast("timestamp_ntz"), "submitted_at": F.lit("2024-01-01 00:05:00").cast("timestamp_ntz")})
    return S.score_rows(i, q), a


def test_totals(spark):
    rows, a = frames(spark)
    t = S.totals(rows, a).first()
    assert (t.correct, t.wrong, t.skipped, t.unscored, t.score, t.max, t.accuracy, t.attempted) == (1, 1, 2, 1, 1.34, 8.0, 50, 3)
    assert (t.gained, t.lost, t.percent) == (2.0, 0.66, 16.8)


def test_time_and_review(spark):
    rows, a = frames(spark)
    r = S.time_and_review(rows, a).first()
    assert (r.tracked, r.per_correct, r.per_wrong, r.over_2min, r.max_time, r.time_used) == (True, 30, 150, 1, 150, 300)
    assert (r.marked_total, r.marked_correct, r.marked_wrong, r.marked_blank) == (2, 0, 1, 1)
    assert (r.changed_total, r.changed_correct, r.changed_wrong, r.not_visited) == (1, 0, 1, 1)
    assert [x.qid for x in S.slowest(rows).orderBy("place").collect()] == ["q2", "q1", "q5", "q3"]


def test_types(spark):
    rows, _ = frames(spark)
    assert [r.type for r in rows.orderBy("idx").collect()] == ["Assertion and reason", "Match the lists", "Statements", "Direct question", "Order and chronology"]
    assert S.by_type(rows).where("place = 1").first().type == "Assertion and reason"


def test_rounding_and_texts(spark):
    r = spark.range(1).select(
        numbers.half_up(F.lit(-2.5)).alias("a"), numbers.cents(F.lit(2 - 0.66)).alias("b"), numbers.clock(F.lit(3725)).alias("c"), numbers.minutes_text(F.lit(5400)).alias("d"),
        text.english_score(F.lit("Which of the following statements is correct?")).alias("e"), text.english_score(F.lit("fuEufyf•r esa ls dkSu&lk dFku lgh gS")).alias("f"),
        text.norm(F.lit("land2")).alias("g"), text.title_from_file(F.lit("My__paper.PDF")).alias("h"), text.english_score(F.lit("12")).alias("i"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.g, r.h, r.i) == (-2, 1.34, "1:02:05", "1 h 30 min", "1 and 2", "My paper", None)
    assert r.e > 0.3 and r.f < 0.06


def test_numbered_paragraphs_are_statements(spark):
    stem = "array<struct<type:string,text:string,rows:array<array<string>>>>"
    rows = [(1, 0, "Consider:", [("p", "Consider:", None), ("p", "1. It rained.", None)]), (2, 0, "Who?", [("p", "Who?", None), ("table", None, [["1. x"]])]), (3, 0, "Match List-I", [("p", "1. Match List-I", None)])]
    q = spark.createDataFrame(rows, f"qid int, answer int, text string, stem {stem}")
    items = spark.createDataFrame([(9, i, i, 0, 1.0, 0) for i in (1, 2, 3)], "attempt_id int, idx int, qid int, resp int, time_s double, changes int")
    assert {r.qid: r.type for r in S.score_rows(items, q).collect()} == {1: "Statements", 2: "Direct question", 3: "Match the lists"}


def test_rescoring_equals_the_full_run(spark):
    """Changed, new, removed and untouched questions; attempts without any of them keep their stored totals."""
    items = spark.createDataFrame([(a, i, 10 * (a % 3) + i, i % 3, False, True, 1.0, 0) for a in range(12) for i in range(5)], "attempt_id long, idx int, qid long, resp int, marked boolean, visited boolean, time_s double, changes int")
    attempts = spark.createDataFrame([(a, 1.0, 0.25) for a in range(12)], "attempt_id long, plus double, minus double")
    before = spark.createDataFrame([(q, q % 3, "Who?") for q in range(24)], "qid long, answer int, text string")
    after = before.where("qid != 11").withColumn("answer", F.when(F.col("qid") == 12, F.lit(None)).otherwise(F.col("answer"))).union(spark.createDataFrame([(24, 1, "New?")], before.schema))
    stored = S.totals(S.score_rows(items, before), attempts)
    assert {r.qid for r in S.changed_questions(before, after).collect()} == {11, 12, 24}
    marked = stored.withColumn("gained", F.when(F.col("attempt_id") % 3 == 0, F.lit(-1.0)).otherwise(F.col("gained")))  # of attempts that are not touched
    got = {r.attempt_id: r for r in S.rescore(marked, items, attempts, before, after).collect()}
    want = {r.attempt_id: r for r in S.totals(S.score_rows(items, after), attempts).collect()}
    assert got.keys() == want.keys()
    for a, r in got.items():
        assert (r.gained == -1.0) if a % 3 == 0 else r == want[a]
