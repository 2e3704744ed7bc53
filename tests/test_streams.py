"""Streams against plain folds: attempt state, attempt life with expiry, and change feeds."""

import random
from datetime import datetime, timedelta, timezone

from gradeloom.operators import events as E
from gradeloom.operators.records import apply_feed, present
from gradeloom.streaming import attempt_state as A
from gradeloom.streaming import live_tests as L

BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)


def files(spark, rows, schema, folder, parts):
    """Rows in as many files, in turns, as a stream that takes one file a batch."""
    for n in range(parts):
        spark.createDataFrame(rows[n::parts], schema).coalesce(1).write.parquet(f"{folder}/part{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part*")


def expected(events, watermark):
    """Life of one attempt from (second, kind, qid, duration) in order, read off with plain lists."""
    start = next((t for t, k, _, _ in events if k == "start"), None)
    ends = None if start is None else start + next(d for _, k, _, d in events if k == "start")
    submits = [t for t, k, _, _ in events if k == "submit" and start is not None and start <= t <= ends and (t, "submit") != (start, "start")]
    after_start = [e for e in events if start is not None and events.index(e) > next(i for i, e in enumerate(events) if e[1] == "start")]
    submits = [t for t, k, _, _ in after_start if k == "submit" and t <= ends]
    late = ends is not None and (any(t > ends for t, *_ in events) or ends <= watermark)
    end = min(submits) if submits else ends if late else None
    live = []
    for e in events:
        if end is not None and (e[0] > end or submits and live and live[-1][1] == "submit" and live[-1] in after_start):
            break
        live.append(e)
    shows = [q for _, k, q, _ in live if k == "show"]
    seconds, last, started = 0.0, None, False
    for t, k, _, _ in live:
        if k == "tick":
            seconds += 0 if last is None else min(5, t - last)
            last = t
        elif k in ("start", "hide"):
            last = None
    return ("submitted" if end is not None else "in-progress" if start is not None else "scheduled", end, end is not None and not submits, len(set(shows)), shows[-1] if shows else None, seconds)


def test_lives_expire_and_end(spark, tmp_path):
    rng = random.Random(3)
    rows, logs = [], {}
    for attempt in range(40):
        times = sorted(rng.sample(range(1, 400), rng.randrange(2, 14)))
        own = [(t, rng.choice(["show", "show", "tick", "tick", "tick", "hide", "submit"]) if n or attempt % 5 == 0 else "start", rng.randrange(4), rng.choice([60, 200]) if not n else None) for n, t in enumerate(times)]
        logs[attempt] = own
        rows += [(f"a{attempt}", BEGIN + timedelta(seconds=t), n, k, f"q{q}", d) for n, (t, k, q, d) in enumerate(own)]
    rng.shuffle(rows)
    rows.append(("clock", BEGIN + timedelta(seconds=2000), 0, "show", "q0", None))  # the last file moves the watermark on
    schema = "attempt_id string, event_time timestamp, seq long, kind string, qid string, duration_sec int"
    stream = files(spark, rows[:-1], schema, f"file://{tmp_path}/log", 2)
    spark.createDataFrame(rows[-1:], schema).coalesce(1).write.parquet(f"file://{tmp_path}/log/part2")
    got = {r.attempt_id: r for r in A.run_available(A.attempt_lives(stream, "1 hour"), f"file://{tmp_path}/work", ("attempt_id",)).collect()}
    for attempt, own in logs.items():
        r, watermark = got[f"a{attempt}"], 2000 - 3600
        status, end, auto, visited, current, seconds = expected(own, watermark)
        at = None if r.submitted_at is None else round((r.submitted_at.replace(tzinfo=timezone.utc) - BEGIN).total_seconds())
        assert (r.status, at, r.auto_submitted, r.visited, r.current, r.seconds) == (status, end, auto, visited, None if current is None else f"q{current}", seconds), (attempt, own)


def test_a_timer_submits_quiet_attempts(spark, tmp_path):
    schema = "attempt_id string, event_time timestamp, seq long, kind string, qid string, duration_sec int"
    rows = [("quiet", BEGIN, 0, "start", None, 60), ("quiet", BEGIN + timedelta(seconds=5), 1, "show", "q1", None)]
    for n, part in enumerate((rows, [("clock", BEGIN + timedelta(hours=9), 0, "show", "q0", None)], [("clock", BEGIN + timedelta(hours=10), 1, "show", "q0", None)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"file://{tmp_path}/log/part{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/log/part*")
    got = {r.attempt_id: r for r in A.run_available(A.attempt_lives(stream, "10 minutes"), f"file://{tmp_path}/work", ("attempt_id",)).collect()}
    assert (got["quiet"].status, got["quiet"].time_used_sec, got["quiet"].auto_submitted, got["quiet"].visited) == ("submitted", 60, True, 1)


def test_states_of_an_attempt_are_one_key(spark, tmp_path):
    """Shuffled files against the fold of whole logs, with names as ids too; the state is asked for attempts, not for questions."""
    rng = random.Random(8)
    rows = [(f"a{a}", BEGIN + timedelta(seconds=rng.randrange(5000)), n, rng.choice(["pick", "pick", "clear", "mark", "unmark", "save", "tick"]), rng.choice([None, *(f"q{q}" for q in range(12))]), rng.randrange(3)) for a in range(9) for n in range(60)]
    rows = [(*r[:5], r[5] if r[3] == "pick" else None) for r in rows]
    rng.shuffle(rows)
    schema, told = "attempt_id string, event_time timestamp, seq long, kind string, qid string, option int", []
    got = A.run_available(A.attempt_states(files(spark, rows, schema, f"file://{tmp_path}/log", 3), "2 hours"), f"file://{tmp_path}/work", told=told).collect()
    want = E.response_state(spark.createDataFrame(rows, schema)).collect()
    names = ("attempt_id", "qid", "response", "changes", "marked", "events")
    assert sorted(str([r[n] for n in names]) for r in got) == sorted(str([r[n] for n in names]) for r in want) and len(got) > 90
    held = [p["stateOperators"][0]["numRowsTotal"] for p in told]
    assert 9 <= max(held) <= 9 * 9, held  # values and timers of nine attempts, whose questions are more


def test_feeds_keep_the_latest(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, value string")
    feed = spark.createDataFrame([(1, "x", 1, False), (1, "y", 2, None), (2, "z", 1, False), (2, None, 2, True), (4, "w", None, None), (3, "old", None, True), (3, "new", 1, False)], "id long, value string, version int, removed boolean")
    assert {r.id: r.value for r in present(apply_feed(table, feed, "id")).collect()} == {1: "y", 3: "new", 4: "w"}
    feed.coalesce(1).write.parquet(f"file://{tmp_path}/feed/part0")
    kept = {"now": table}

    def write(df):
        kept["now"] = spark.createDataFrame(df.collect(), df.schema)

    query = A.watch(spark.readStream.schema(feed.schema).parquet(f"file://{tmp_path}/feed/part*"), lambda _: kept["now"], write, "id", f"file://{tmp_path}/state")
    query.processAllAvailable()
    query.stop()
    assert {r.id: r.value for r in present(kept["now"]).collect()} == {1: "y", 3: "new", 4: "w"}


def test_any_order_of_batches_gives_one_table(spark):
    """Older versions, repeated batches, equal versions and removals included."""
    rng = random.Random(9)
    schema = "id long, value string, version int, removed boolean"
    rows = [(rng.randrange(12), rng.choice("abc"), rng.choice([None, 1, 1, 2, 3]), rng.choice([None, False, False, True])) for _ in range(60)]
    batches = [spark.createDataFrame(rows[n::4], schema) for n in range(4)]
    seen = set()
    for order in ([0, 1, 2, 3], [3, 2, 1, 0], [2, 0, 2, 3, 1, 0]):
        table = spark.createDataFrame([(i, "start") for i in range(5)], "id long, value string")
        for n in order:
            table = apply_feed(table, batches[n], "id")
        seen.add(frozenset((r.id, r.value) for r in present(table).collect()))
    want = {}
    for i, value, version, removed in rows + [(i, "start", None, False) for i in range(5)]:
        want[i] = max(want.get(i, ((-2,),)), ((-1 if version is None else version, bool(removed), value),))
    assert seen == {frozenset((i, v[0][2]) for i, v in want.items() if not v[0][1])}


LOG = "attempt_id long, event_time timestamp, seq long, kind string, qid int, option int, duration_sec int"


def random_log(rng, attempts):
    kinds = ["pick"] * 4 + ["show", "tick", "tick", "tick", "hide", "mark", "unmark", "save", "clear", "start", "submit"]
    rows = []
    for attempt in range(attempts):
        for seq in range(rng.randrange(1, 30)):
            kind = "start" if seq == attempt % 3 else rng.choice(kinds)
            at = BEGIN + timedelta(seconds=600 * attempt + rng.randrange(900))
            rows.append((attempt, at, seq, kind, rng.choice([None, *range(4)]), rng.randrange(3) if kind == "pick" else None, rng.choice([300, 600]) if kind == "start" else None))
    rng.shuffle(rows)
    return rows


def test_live_tests_equal_windows(spark, tmp_path):
    """Shuffled files against the windows over the whole log; ends by submit, by time, and by a timer."""
    rows = random_log(random.Random(12), 40)
    stream = files(spark, rows, LOG, f"file://{tmp_path}/log", 3)
    told = []
    got = A.run_available(L.live_tests(stream, "12 hours", 40.0), f"file://{tmp_path}/work", last=("submitted_at", "events"), told=told).collect()
    whole = spark.createDataFrame(rows, LOG)
    want = {(r.attempt_id, r.qid): r for r in E.live_questions(whole, 40.0).collect()}
    questions = {(r.attempt_id, r.qid): r for r in got if r.qid is not None and r.events}
    assert questions.keys() == want.keys() and len(want) > 60
    for k, r in questions.items():
        assert (r.response, r.changes, r.marked, r.events, r.visited) == tuple(want[k][c] for c in ("response", "changes", "marked", "events", "visited")), k
        assert abs(r.seconds - want[k].seconds) < 1e-6
    own = {}
    for a, at, seq, kind, _, _, duration in sorted(rows, key=lambda r: (r[1], r[2])):
        life = own.get(a)
        if life is None:
            if kind == "start":
                own[a] = [at, at + timedelta(seconds=duration), None, False]
        elif life[2] is None:
            if at > life[1]:
                life[2:] = [life[1], True]
            elif kind == "submit":
                life[2:] = [at, False]
    lives = {r.attempt_id: [x if x is None else x.replace(tzinfo=timezone.utc) for x in (r.started_at, r.ends_at, r.submitted_at)] + [r.auto_submitted] for r in got if r.qid is None}
    assert lives == own and sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in told) == 0


def test_state_leaves_with_the_attempts(spark, tmp_path):
    """When the watermark has passed all ends, no row of state is left; void questions have no events."""
    rows = sorted(random_log(random.Random(5), 25), key=lambda r: (r[1], r[2]))
    clock = [(-1, BEGIN + timedelta(days=d), d, "hide", None, None, None) for d in (3, 6, 9)]
    for n, part in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 :], *[[c] for c in clock])):
        spark.createDataFrame(part, LOG).coalesce(1).write.parquet(f"file://{tmp_path}/log/part{n}")
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/log/part*")
    told = []
    got = A.run_available(L.live_tests(stream, "1 hour", linger=3600.0), f"file://{tmp_path}/work", last=("submitted_at", "events"), told=told).collect()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in told]
    assert max(held) >= 25 and held[-1] <= 2, held  # what is left is the clock's own last event
    assert all(r.status == "submitted" for r in got if r.qid is None)
    want = {(r.attempt_id, r.qid): r.events for r in E.live_questions(spark.createDataFrame(rows, LOG)).collect()}
    assert {(r.attempt_id, r.qid): r.events for r in got if r.qid is not None and r.events} == want


def test_late_rows_are_dealt_out(spark, tmp_path):
    """In time and late ones together are what was read; a stream over those in time drops none."""
    rows = random_log(random.Random(3), 30)
    rows.append((99, None, 0, "start", None, None, 60))
    rows.sort(key=lambda r: 0 if r[1] is None else r[1].timestamp() + random.Random(r[0] * 100 + r[2]).randrange(4000))
    top, want, out = None, set(), f"file://{tmp_path}/dealt"
    for n in range(3):
        part = rows[n * len(rows) // 3 : (n + 1) * len(rows) // 3]
        spark.createDataFrame(part, LOG).coalesce(2).write.mode("append").parquet(f"file://{tmp_path}/log")
        L.split_late(spark.readStream.schema(LOG).parquet(f"file://{tmp_path}/log"), out, 600, f"file://{tmp_path}/point")
        late = {(r[0], r[2]) for r in part if r[1] is None or top is not None and r[1] <= top - timedelta(seconds=600)}
        want |= {(r[0], r[2], n, (r[0], r[2]) in late) for r in part}
        top = max([r[1] for r in part if (r[0], r[2]) not in late] + ([top] if top else []))
    got = {(r.attempt_id, r.seq, r.batch, r.late) for r in L.dealt(spark, out, LOG).collect()}
    assert got == want and sum(g[3] for g in got) > 5
    told = []
    A.run_available(L.live_tests(L.in_time(spark, out, LOG), "10 minutes"), f"file://{tmp_path}/work", told=told).collect()
    assert sum(p["numInputRows"] for p in told) == sum(not g[3] for g in got) and sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in told) == 0
