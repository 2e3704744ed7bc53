"""Registered queries on attempt events, with the SQL they are compared with."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gradeloom.operators import events as E
from gradeloom.sources import exam_tables as T
from gradeloom.sources.exam_tables import with_tables
from gradeloom.sources.scratch import scratch
from gradeloom.streaming import attempt_state as A
from gradeloom.streaming import live_tests as L


def response_states(spark, sf_dir):
    """Response, changes and mark of every question from the log."""
    return E.response_state(T.attempt_events(spark, sf_dir))


def response_states_in_time(spark, sf_dir):
    """The same from events up to ten days after the attempt's first."""
    log = T.attempt_events(spark, sf_dir)
    ends = log.groupBy("attempt_id").agg(F.timestamp_add("DAY", F.lit(10), F.min("event_time")).alias("ends_at"))
    return E.response_state(E.in_time(log, ends))


def _shown(log):
    """A log in which a view puts its question on screen."""
    return log.withColumn("kind", F.when(F.col("kind") == "tick", "show").otherwise(F.col("kind")))


def visited_questions(spark, sf_dir):
    """Questions seen and the current one of every attempt."""
    return E.visited(_shown(T.attempt_events(spark, sf_dir)))


def time_spent(spark, sf_dir):
    """Seconds on every question."""
    return E.time_spent(T.attempt_events(spark, sf_dir), 40_000.0)


def expired_attempts(spark, sf_dir):
    """Attempts after all that ran out by a date are submitted."""
    return E.expire(T.attempts(spark, sf_dir), F.lit("1997-06-01").cast("timestamp_ntz")).select("attempt_id", "status", "submitted_at", "time_used_sec", "auto_submitted")


def submitted_attempts(spark, sf_dir):
    """Running attempts that a submit event ends."""
    a = T.attempts(spark, sf_dir)
    events = a.where("attempt_id % 2 = 0").select("attempt_id", F.timestamp_add("SECOND", (F.col("attempt_id") % 9000).cast("int"), F.col("started_at")).alias("event_time"))
    return E.submit(a, events).select("attempt_id", "status", "submitted_at", "time_used_sec")


def activity_windows(spark, sf_dir):
    """Events of every attempt in five-minute windows."""
    return E.activity(T.attempt_events(spark, sf_dir))


def activity_sessions(spark, sf_dir):
    """Stretches of events with pauses below half a day."""
    return E.sessions(T.attempt_events(spark, sf_dir), "12 hours")


def streamed_states(spark, sf_dir):
    """response_states, folded by a stateful stream over the event files."""
    e = A.event_stream(spark, sf_dir)
    kinds = F.create_map(*map(F.lit, ("click", "pick", "error", "clear", "signup", "mark", "purchase", "save", "view", "tick")))
    kind = kinds[F.col("event_type")]
    log = e.select(
        F.col("user_id").alias("attempt_id"), F.col("ts").alias("event_time"), F.col("event_id").alias("seq"), kind.alias("kind"),
        (F.get_json_object("props", "$.k").cast("int") % 10).alias("qid"), F.when(kind == "pick", (F.floor("value") % 4).cast("int")).alias("option"),
    )
    return A.run_available(A.attempt_states(log), f"{scratch(spark)}/streams")


LIVE = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING, event_time TIMESTAMP"


def _live(e):
    """Events as logs of live tests: sign-ups start a test of eight days, some purchases submit it."""
    kind, n = F.col("event_type"), F.col("event_id")
    third = F.pmod(n, F.lit(3))
    kind = (
        F.when(kind == "click", "pick").when(kind == "signup", "start").when(kind == "view", F.when(third == 0, "show").otherwise("tick"))
        .when(kind == "error", F.when(third == 0, "clear").when(third == 1, "mark").otherwise("hide")).otherwise(F.when(n % 9 == 0, "submit").when(n % 4 == 1, "unmark").otherwise("save"))
    )
    return e.select(
        F.col("user_id").alias("attempt_id"), F.col("ts").alias("event_time"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.get_json_object("props", "$.k").cast("int") % 10).alias("qid"),
        F.when(kind == "pick", (F.floor("value") % 4).cast("int")).alias("option"), F.when(kind == "start", F.lit(8 * 86_400)).alias("duration_sec"),
    )


def _arrivals(spark, sf_dir, folder: str, delay_sec: float):
    """The event files as they arrive, ten days at a time but up to a day late; each is dealt into rows in time and late ones."""
    e = T.read(spark, sf_dir, "events").withColumn("event_time", F.col("ts").cast("timestamp"))
    e = e.select(*(F.col(f.split()[0]).cast(f.split()[1]) for f in LIVE.split(", "))).withColumn("part", F.floor((F.unix_seconds("event_time") + F.col("event_id") * 7919 % 86_400) / 864_000))
    for part in sorted(r["part"] for r in e.select("part").distinct().collect()):
        e.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}/arrived")
        L.split_late(spark.readStream.schema(LIVE).parquet(f"{folder}/arrived"), folder, delay_sec, f"{folder}/dealt")
        yield part


def late_events(spark, sf_dir):
    """Every event with the batch it came in, and whether it came too late for a watermark of twenty minutes."""
    folder = f"{scratch(spark)}/late/{uuid.uuid4().hex}"
    for _ in _arrivals(spark, sf_dir, folder, 1200):
        pass
    return L.dealt(spark, folder, LIVE).select("event_id", "batch", "late")


def live_questions(spark, sf_dir):
    """State, time and visits of every question of a live test, from whole logs."""
    rows = E.live_questions(_live(T.read(spark, sf_dir, "events")), 40_000.0)
    return rows.withColumn("seconds", F.round("seconds", 3))


def live_tests_streamed(spark, sf_dir):
    """The same and the ends of attempts by one stateful stream, run each time that events arrive; late ones are left out."""
    folder = f"{scratch(spark)}/live/{uuid.uuid4().hex}"
    for _ in _arrivals(spark, sf_dir, folder, 1200):
        stream = L.live_tests(_live(L.in_time(spark, folder, LIVE)), "20 minutes", 40_000.0, linger=60 * 86_400.0)
        rows = A.run_available(stream, folder, last=("submitted_at", "events"), work=f"{folder}/state")
    rows = rows.where("events > 0 OR qid IS NULL").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ends_at", "submitted_at")})
    return rows.withColumn("seconds", F.round("seconds", 3))


QUERIES = {f.__name__: f for f in (response_states, response_states_in_time, visited_questions, time_spent, expired_attempts, submitted_attempts, activity_windows, activity_sessions, streamed_states, late_events, live_questions, live_tests_streamed)}

_FOLD = """, o AS (SELECT *, row_number() OVER (PARTITION BY attempt_id, qid ORDER BY event_time, seq) AS n FROM l),
  f AS (SELECT attempt_id, qid, 0::BIGINT AS n, NULL::INT AS response, 0::BIGINT AS changes, false AS marked FROM o WHERE n = 1
    UNION ALL SELECT o.attempt_id, o.qid, o.n, CASE o.kind WHEN 'pick' THEN CASE WHEN f.response IS NOT DISTINCT FROM o.option THEN NULL ELSE o.option END WHEN 'clear' THEN NULL ELSE f.response END,
      f.changes + CASE WHEN o.kind = 'pick' AND f.response IS NOT NULL AND f.response <> o.option THEN 1 ELSE 0 END,
      CASE WHEN o.kind = 'mark' THEN true WHEN o.kind = 'unmark' OR (o.kind = 'save' AND f.response IS NOT NULL) THEN false ELSE f.marked END
      FROM f JOIN o ON o.attempt_id = f.attempt_id AND o.qid = f.qid AND o.n = f.n + 1)
  SELECT attempt_id, qid, response, changes, marked, n AS events FROM f QUALIFY n = max(n) OVER (PARTITION BY attempt_id, qid)"""


def _fold(l: str) -> str:
    return "WITH RECURSIVE" + with_tables("log").removeprefix("WITH") + f", l AS ({l})" + _FOLD


#: Events with the batch they come in and whether they are late, then those of live tests that count.
_BATCHES = """e AS (SELECT *, dense_rank() OVER (ORDER BY CAST(floor((floor(epoch(ts)) + event_id * 7919 % 86_400) / 864000) AS BIGINT)) - 1 AS batch FROM events),
  tops AS (SELECT a.batch, max(b.ts) AS top FROM (SELECT DISTINCT batch FROM e) a LEFT JOIN e b ON b.batch < a.batch GROUP BY 1),
  dealt AS (SELECT e.*, coalesce(ts <= top - INTERVAL 20 MINUTE, false) AS late FROM e JOIN tops USING (batch))"""


def _live_sql(table: str) -> str:
    return f"""log AS (SELECT user_id AS attempt_id, ts AS event_time, event_id AS seq, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS qid,
    CASE event_type WHEN 'click' THEN 'pick' WHEN 'signup' THEN 'start' WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'show' ELSE 'tick' END
      WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'clear' WHEN 1 THEN 'mark' ELSE 'hide' END ELSE CASE WHEN event_id % 9 = 0 THEN 'submit' WHEN event_id % 4 = 1 THEN 'unmark' ELSE 'save' END END AS kind,
    CASE WHEN event_type = 'click' THEN CAST(floor(value) AS INT) % 4 END AS option FROM {table}),
  st AS (SELECT attempt_id, min((event_time, seq)) AS at FROM log WHERE kind = 'start' GROUP BY 1),
  a AS (SELECT log.*, st.at[1] AS started_at, st.at[1] + INTERVAL 8 DAY AS ends_at FROM log JOIN st ON st.attempt_id = log.attempt_id AND (event_time, seq) >= st.at),
  en AS (SELECT attempt_id, min((event_time, seq)) AS at FROM a WHERE kind = 'submit' AND event_time <= ends_at GROUP BY 1),
  live AS (SELECT a.* FROM a LEFT JOIN en ON en.attempt_id = a.attempt_id WHERE event_time <= ends_at AND (en.at IS NULL OR (event_time, seq) < en.at)),
  gaps AS (SELECT attempt_id, qid, kind, lag(kind) OVER w AS last, (epoch_us(event_time) - lag(epoch_us(event_time)) OVER w) / 1e6::DOUBLE AS gap FROM live WHERE kind IN ('tick', 'start', 'hide') WINDOW w AS (PARTITION BY attempt_id ORDER BY event_time, seq)),
  spent AS (SELECT attempt_id, qid, sum(CASE WHEN last = 'tick' THEN least(40000, gap) ELSE 0 END) AS seconds FROM gaps WHERE kind = 'tick' GROUP BY ALL),
  seen AS (SELECT attempt_id, qid, bool_or(kind = 'show') AS visited FROM live WHERE kind NOT IN ('start', 'hide') GROUP BY ALL),
  l AS (SELECT * FROM live WHERE kind NOT IN ('start', 'hide'))""" + _FOLD.replace("SELECT attempt_id, qid, response, changes, marked, n AS events FROM f", ", q AS (SELECT attempt_id, qid, response, changes, marked, n AS events FROM f") + """),
  questions AS (SELECT q.*, round(coalesce(seconds, 0), 3) AS seconds, visited FROM q LEFT JOIN spent USING (attempt_id, qid) JOIN seen USING (attempt_id, qid))"""


SQL = {
    "late_events": f"WITH {_BATCHES} SELECT event_id, CAST(batch AS INT) AS batch, late FROM dealt",
    "live_questions": f"WITH RECURSIVE {_live_sql('events')} SELECT attempt_id, qid, response, changes, marked, events, seconds, visited FROM questions",
    "live_tests_streamed": f"""WITH RECURSIVE {_BATCHES}, kept AS (SELECT * FROM dealt WHERE NOT late), {_live_sql('kept')},
  passed AS (SELECT max(event_time) - INTERVAL 20 MINUTE AS at FROM log), after AS (SELECT attempt_id, bool_or(event_time > ends_at) AS up, min(started_at) AS started_at, min(ends_at) AS ends_at FROM a GROUP BY 1),
  shown AS (SELECT attempt_id, arg_max(qid, (event_time, seq)) AS current FROM live WHERE kind = 'show' GROUP BY 1),
  att AS (SELECT attempt_id, started_at, ends_at, CASE WHEN en.at IS NOT NULL THEN en.at[1] WHEN up OR ends_at <= passed.at THEN ends_at END AS submitted_at, en.at IS NULL AND (up OR ends_at <= passed.at) AS auto_submitted, current
    FROM after LEFT JOIN en USING (attempt_id) LEFT JOIN shown USING (attempt_id), passed)
  SELECT attempt_id, qid, response, changes, marked, events, seconds, visited, NULL AS status, NULL::TIMESTAMP AS started_at, NULL::TIMESTAMP AS ends_at, NULL::TIMESTAMP AS submitted_at, NULL::INT AS time_used_sec, NULL::BOOLEAN AS auto_submitted, NULL::INT AS current FROM questions
  UNION ALL SELECT attempt_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN submitted_at IS NULL THEN 'in-progress' ELSE 'submitted' END, started_at, ends_at, submitted_at, CAST(floor((epoch_us(submitted_at) - epoch_us(started_at)) / 1e6::DOUBLE + 0.5) AS INT), auto_submitted, current FROM att""",
    "response_states": _fold("SELECT * FROM log"),
    "response_states_in_time": _fold("SELECT * FROM log QUALIFY event_time <= min(event_time) OVER (PARTITION BY attempt_id) + INTERVAL 10 DAY"),
    "streamed_states": _fold("SELECT * FROM log"),
    "visited_questions": with_tables("log") + " SELECT attempt_id, count(DISTINCT qid) AS visited, arg_max(qid, (event_time, seq)) AS current FROM log WHERE kind = 'tick' GROUP BY attempt_id",
    "time_spent": with_tables("log") + """, t AS (SELECT attempt_id, qid, epoch_us(event_time) - lag(epoch_us(event_time)) OVER (PARTITION BY attempt_id ORDER BY event_time, seq) AS gap FROM log WHERE kind = 'tick')
  SELECT attempt_id, qid, sum(CASE WHEN gap IS NULL THEN 0 ELSE least(40000, gap / 1e6::DOUBLE) END) AS seconds FROM t GROUP BY ALL""",
    "expired_attempts": with_tables("attempts") + """, u AS (SELECT *, started_at + to_seconds(duration_sec) AS ends_at, status = 'in-progress' AND started_at + to_seconds(duration_sec) <= TIMESTAMP '1997-06-01' AS up FROM attempts)
  SELECT attempt_id, CASE WHEN up THEN 'submitted' ELSE status END AS status, CASE WHEN up THEN ends_at ELSE submitted_at END AS submitted_at, CASE WHEN up THEN duration_sec ELSE time_used_sec END AS time_used_sec, up AS auto_submitted FROM u""",
    "submitted_attempts": with_tables("attempts") + """, u AS (SELECT *, least(attempt_id % 9000, duration_sec) AS used, status = 'in-progress' AND attempt_id % 2 = 0 AS now FROM attempts)
  SELECT attempt_id, CASE WHEN now THEN 'submitted' ELSE status END AS status, CASE WHEN now THEN started_at + to_seconds(used) ELSE submitted_at END AS submitted_at, CAST(CASE WHEN now THEN used ELSE time_used_sec END AS INT) AS time_used_sec FROM u""",
    "activity_windows": with_tables("log") + " SELECT attempt_id, time_bucket(INTERVAL 5 MINUTE, event_time) AS window_start, count(*) AS events FROM log GROUP BY ALL",
    "activity_sessions": with_tables("log") + """, g AS (SELECT *, coalesce(event_time >= lag(event_time) OVER w + INTERVAL 12 HOUR, false) AS cut FROM log WINDOW w AS (PARTITION BY attempt_id ORDER BY event_time, seq)),
  i AS (SELECT *, count_if(cut) OVER (PARTITION BY attempt_id ORDER BY event_time, seq) AS s FROM g) SELECT attempt_id, min(event_time) AS session_start, count(*) AS events FROM i GROUP BY attempt_id, s""",
}
