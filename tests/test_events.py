import random

from pyspark.sql import functions as F

from gradeloom.operators import events as E
from gradeloom.streaming.attempt_state import fold

SCHEMA = "attempt_id long, event_time timestamp, seq long, kind string, qid int, option int"
LOGS = [
    ([("pick", 0), ("pick", 1)], (1, 1, False)), ([("pick", 0), ("pick", 0)], (None, 0, False)), ([("pick", 0), ("pick", 0), ("pick", 1)], (1, 0, False)),
    ([("pick", 0), ("clear", None), ("pick", 1)], (1, 0, False)), ([("mark", None), ("save", None)], (None, 0, True)), ([("mark", None), ("pick", 2), ("save", None)], (2, 0, False)),
]


def log(spark, logs):
    rows = [(i, n, kind, option) for i, own in enumerate(logs) for n, (kind, option) in enumerate(own)]
    df = spark.createDataFrame(rows, "attempt_id long, seq long, kind string, option int")
    return df.select("attempt_id", F.timestamp_seconds(F.col("seq")).alias("event_time"), "seq", "kind", F.lit(1).alias("qid"), "option")


def test_logs_by_hand(spark):
    got = {r.attempt_id: (r.response, r.changes, r.marked) for r in E.response_state(log(spark, [x for x, _ in LOGS])).collect()}
    assert got == {i: want for i, (_, want) in enumerate(LOGS)}


def test_windows_equal_a_fold(spark):
    rng = random.Random(5)
    kinds = ["pick"] * 5 + ["clear", "mark", "unmark", "save"]
    logs = [[(k, rng.randrange(3) if k == "pick" else None) for k in rng.choices(kinds, k=rng.randrange(1, 12))] for _ in range(3000)]
    got = {r.attempt_id: (r.response, r.changes, r.marked) for r in E.response_state(log(spark, logs)).collect()}
    for i, own in enumerate(logs):
        state = (None, 0, False, 0)
        for kind, option in own:
            state = fold(state, kind, option)
        assert got[i] == state[:3], own


def test_time_stops_while_hidden(spark):
    rows = [(1, 0, "start", 1), (1, 1, "tick", 1), (1, 4, "tick", 1), (1, 20, "tick", 2), (1, 21, "hide", 2), (1, 90, "tick", 2), (1, 91, "tick", 2)]
    df = spark.createDataFrame(rows, "attempt_id long, seq long, kind string, qid int").withColumn("event_time", F.timestamp_seconds("seq"))
    assert {r.qid: r.seconds for r in E.time_spent(df).collect()} == {1: 3.0, 2: 6.0}


def test_visits_and_events_after_the_end(spark):
    rows = [(1, 0, "show", 4), (1, 1, "show", 5), (1, 2, "pick", 9), (1, 3, "submit", None), (1, 4, "show", 6), (2, 0, "pick", 1), (3, 1, "show", 1), (3, 50, "show", 2)]
    df = spark.createDataFrame(rows, "attempt_id long, seq long, kind string, qid int").withColumn("event_time", F.timestamp_seconds("seq"))
    assert {r.attempt_id: (r.visited, r.current) for r in E.visited(df).collect()} == {1: (3, 6), 3: (2, 2)}
    ends = df.select("attempt_id", F.timestamp_seconds(F.lit(20)).alias("ends_at")).distinct()
    assert {r.attempt_id: (r.visited, r.current) for r in E.visited(E.in_time(df, ends)).collect()} == {1: (2, 5), 3: (1, 1)}


def test_ended_attempts_stay_marked(spark):
    rows = spark.createDataFrame([(1, "in-progress", 60), (2, "in-progress", 10**6)], "attempt_id long, status string, duration_sec int")
    rows = rows.withColumns({"started_at": F.timestamp_seconds(F.lit(0)), "submitted_at": F.lit(None).cast("timestamp"), "time_used_sec": F.lit(None).cast("int")})
    once = E.expire(rows, F.timestamp_seconds(F.lit(100)))
    for df in (once, E.expire(once, F.timestamp_seconds(F.lit(100)))):
        assert {r.attempt_id: (r.status, r.auto_submitted) for r in df.collect()} == {1: ("submitted", True), 2: ("in-progress", False)}
