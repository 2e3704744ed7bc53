"""Attempt state from its event log, with windows only.

A log has attempt_id, event_time, seq, kind, qid and option. Kinds: start, show, tick, hide, pick, clear,
mark, unmark, save, submit. Order is (event_time, seq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.numbers import half_up

ORDER = ("event_time", "seq")


def response_state(log: DataFrame) -> DataFrame:
    """attempt_id, qid, response, changes, marked, events for every question with an event.

    A pick of the chosen option takes it back, another pick replaces it and counts as a change, clear takes
    it away. mark sets and unmark unsets the mark; save unsets it only while there is a response.
    Picks of one option in a row, between two clears, form an island; after an odd number of them the
    option is chosen. All windows start with attempt and question: one exchange serves them all.
    """
    key = ["attempt_id", "qid"]
    pick = F.col("kind") == "pick"
    running = (Window.unboundedPreceding, Window.currentRow)
    rows = log.withColumn("epoch", F.sum((F.col("kind") == "clear").cast("int")).over(Window.partitionBy(*key).orderBy(*ORDER).rowsBetween(*running)))
    epoch = Window.partitionBy(*key, "epoch").orderBy(*ORDER)
    rows = rows.withColumn("before", F.last(F.when(pick, F.col("option")), ignorenulls=True).over(epoch.rowsBetween(Window.unboundedPreceding, -1)))
    opens = pick & ~F.col("before").eqNullSafe(F.col("option"))
    rows = rows.withColumn("opens", opens).withColumn("island", F.sum(F.col("opens").cast("int")).over(epoch.rowsBetween(*running)))
    island = Window.partitionBy(*key, "epoch", "island").orderBy(*ORDER)
    rows = rows.withColumn("p", F.sum(pick.cast("int")).over(island.rowsBetween(*running)))
    rows = rows.withColumn("changed", F.col("opens") & (F.col("island") > 1) & (F.lag("p").over(epoch) % 2 == 1))
    chosen = F.col("p") % 2 == 1
    now = F.when(chosen, F.when(pick, F.col("option")).otherwise(F.col("before")))
    sets = F.when(F.col("kind") == "mark", True).when((F.col("kind") == "unmark") | ((F.col("kind") == "save") & chosen), False)
    at = F.struct(*ORDER)
    return rows.groupBy(*key).agg(
        F.max_by(F.struct(now.alias("r")), at)["r"].alias("response"), F.count_if("changed").alias("changes"),
        F.coalesce(F.max_by(sets, F.when(sets.isNotNull(), at)), F.lit(False)).alias("marked"), F.count(F.lit(1)).alias("events"),
    )


def visited(log: DataFrame) -> DataFrame:
    """attempt_id, visited (number of questions ever on screen), current (the question shown last).

    Only show events count: a submit, say, has no question. Attempts that never showed one have no row.
    """
    return log.where("kind = 'show' AND qid IS NOT NULL").groupBy("attempt_id").agg(F.count_distinct("qid").alias("visited"), F.max_by("qid", F.struct(*ORDER)).alias("current"))


def time_spent(log: DataFrame, most: float = 5.0) -> DataFrame:
    """attempt_id, qid, seconds: from tick to tick, `most` at a time, for the question on screen at the later one.

    Nothing counts from a start or a hidden stretch to the next tick.
    """
    rows = log.where("kind IN ('tick', 'start', 'hide')")
    order = Window.partitionBy("attempt_id").orderBy(*ORDER)
    micros = F.unix_micros(F.col("event_time").cast("timestamp"))
    rows = rows.select("attempt_id", "qid", "kind", F.lag("kind").over(order).alias("last"), ((micros - F.lag(micros).over(order)) / 1e6).alias("gap"))
    counted = F.when(F.col("last") == "tick", F.least(F.lit(most), "gap")).otherwise(F.lit(0.0))
    return rows.where("kind = 'tick'").groupBy("attempt_id", "qid").agg(F.sum(counted).alias("seconds"))


def expire(attempts: DataFrame, as_of) -> DataFrame:
    """Attempts with ends_at; those in progress whose time is up by as_of are submitted at their end.

    An attempt that an earlier run has ended stays marked as such (auto_submitted).
    """
    ends = F.timestamp_add("SECOND", F.col("duration_sec"), F.col("started_at"))
    rows = attempts.withColumn("ends_at", ends)
    up = (F.col("status") == "in-progress") & (F.col("ends_at") <= as_of)
    return rows.withColumns({
        "time_used_sec": F.when(up, F.col("duration_sec")).otherwise(F.col("time_used_sec")), "submitted_at": F.when(up, F.col("ends_at")).otherwise(F.col("submitted_at")),
        "auto_submitted": (up | F.coalesce(F.col("auto_submitted"), F.lit(False))) if "auto_submitted" in attempts.columns else up, "status": F.when(up, "submitted").otherwise(F.col("status")),
    })


def submit(attempts: DataFrame, submits: DataFrame) -> DataFrame:
    """Running attempts with a submit event (attempt_id, event_time) end then, or at ends_at if that is sooner."""
    first = submits.groupBy("attempt_id").agg(F.min("event_time").alias("_at"))
    ends = F.timestamp_add("SECOND", F.col("duration_sec"), F.col("started_at"))
    rows = attempts.join(first, "attempt_id", "left").withColumn("_at", F.when(F.col("_at").isNotNull(), F.least("_at", ends)))
    now = (F.col("status") == "in-progress") & F.col("_at").isNotNull()
    used = half_up((F.unix_micros(F.col("_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6).cast("int")
    return rows.withColumns({
        "submitted_at": F.when(now, F.col("_at")).otherwise(F.col("submitted_at")), "time_used_sec": F.when(now, used).otherwise(F.col("time_used_sec")),
        "status": F.when(now, "submitted").otherwise(F.col("status")),
    }).drop("_at")


def in_time(log: DataFrame, ends: DataFrame) -> DataFrame:
    """Events of an attempt that are neither after its end (attempt_id, ends_at) nor after its first submit; later ones have no effect."""
    at = F.struct(*ORDER)
    submits = log.where("kind = 'submit'").groupBy("attempt_id").agg(F.min(at).alias("_submit"))
    rows = log.join(ends, "attempt_id").join(submits, "attempt_id", "left")
    return rows.where((F.col("event_time") <= F.col("ends_at")) & F.coalesce(at <= F.col("_submit"), F.lit(True))).drop("ends_at", "_submit")


def live_log(log: DataFrame) -> DataFrame:
    """The events of live tests that count, with ends_at: from the first start (which gives duration_sec) to the end.

    The end is the first submit after the start, or the time that the start allows; the submit is left out.
    """
    own = Window.partitionBy("attempt_id")
    at, first = F.struct(*ORDER), F.struct(*ORDER, "duration_sec")
    rows = log.withColumn("_start", F.min(F.when(F.col("kind") == "start", first)).over(own))
    rows = rows.withColumn("ends_at", F.timestamp_add("SECOND", F.coalesce(F.col("_start.duration_sec"), F.lit(0)), F.col("_start.event_time")))
    rows = rows.where(at >= F.struct(*(F.col(f"_start.{c}") for c in ORDER)))
    end = F.min(F.when(F.col("kind") == "submit", at)).over(own)
    return rows.withColumn("_end", end).where((F.col("event_time") <= F.col("ends_at")) & (F.col("_end").isNull() | (at < F.col("_end")))).drop("_start", "_end")


def live_questions(log: DataFrame, most: float = 5.0) -> DataFrame:
    """attempt_id, qid, response, changes, marked, events, seconds, visited of live tests, from whole logs."""
    rows = live_log(log)
    asked = rows.where("qid IS NOT NULL AND kind NOT IN ('start', 'hide')")
    key = ["attempt_id", "qid"]
    seen = asked.groupBy(*key).agg(F.bool_or(F.col("kind") == "show").alias("visited"))
    states = response_state(asked).join(seen, key).join(time_spent(rows, most).where("qid IS NOT NULL"), key, "left")
    return states.withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))


def activity(log: DataFrame, length: str = "5 minutes") -> DataFrame:
    """Events of each attempt and window."""
    rows = log.groupBy("attempt_id", F.window(F.col("event_time").cast("timestamp"), length)).agg(F.count(F.lit(1)).alias("events"))
    return rows.select("attempt_id", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "events")


def sessions(log: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Stretches of each attempt's events without a pause of `gap`."""
    rows = log.groupBy("attempt_id", F.session_window(F.col("event_time").cast("timestamp"), gap)).agg(F.count(F.lit(1)).alias("events"))
    return rows.select("attempt_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), "events")
