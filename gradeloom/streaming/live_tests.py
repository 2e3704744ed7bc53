"""Whole live tests as one stream: responses, marks, time and visits of every question, and the end of the attempt.

A log has attempt_id, event_time, seq, kind, qid, option and, on a start, duration_sec. Order is (event_time, seq).
Nothing counts before the first start or after the end, which is the first submit or the end of the time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gradeloom.streaming.attempt_state import fold

#: What of an attempt and of a question is kept; times are microseconds.
LIFE = ("started", "ends", "ended", "auto", "current", "tick")
QUESTION = ("response", "changes", "marked", "events", "seconds", "visited")
BLANK = (None, 0, False, 0, 0.0, False)
OUT = (
    "attempt_id {attempt}, qid {question}, response INT, changes BIGINT, marked BOOLEAN, events BIGINT, seconds DOUBLE, visited BOOLEAN, "
    "status STRING, started_at TIMESTAMP, ends_at TIMESTAMP, submitted_at TIMESTAMP, time_used_sec INT, auto_submitted BOOLEAN, current {question}"
)
#: Seconds that count from one tick to the next at most.
MOST = 5.0


def step(life: dict | None, questions: dict, event: tuple, most: float = MOST) -> dict | None:
    """The attempt after one event more; changes the states of questions (qid to QUESTION) in place."""
    micros, _, kind, qid, option, duration = event
    if life is None:
        return dict(zip(LIFE, (micros, micros + int(duration or 0) * 1_000_000, None, False, None, None), strict=True)) if kind == "start" else None
    if life["ended"] is not None:
        return life
    if micros > life["ends"]:
        return life | {"ended": life["ends"], "auto": True}
    if kind == "submit":
        return life | {"ended": micros}
    if kind in ("start", "hide"):
        return life | {"tick": None}
    if qid is not None:
        response, changes, marked, events, seconds, visited = questions.get(qid, BLANK)
        if kind == "tick" and life["tick"] is not None:
            seconds += min(most, (micros - life["tick"]) / 1e6)
        questions[qid] = (*fold((response, changes, marked, events), kind, option), seconds, visited or kind == "show")
        if kind == "show":
            life = life | {"current": qid}
    return life | {"tick": micros} if kind == "tick" else life


class LiveTest(StatefulProcessor):
    """One attempt: its life, a map of its questions, and the events that the watermark has not passed.

    Events are folded for good, in order, once the watermark has passed them. What is emitted after each batch
    are the questions that could have changed, kept events included, and the attempt itself (a row without a
    question). A question whose events turn out to be void has a row with 0 events. A timer ends attempts at
    their time. With its end an attempt leaves all its state but a mark, and that goes after `linger` seconds;
    events before a start leave none.
    """

    def __init__(self, question: str, most: float = MOST, linger: float = 86_400.0):
        self.question, self.most, self.linger = question, most, int(linger * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", f"started BIGINT, ends BIGINT, ended BIGINT, auto BOOLEAN, current {self.question}, tick BIGINT")
        self.questions = handle.getMapState("questions", f"qid {self.question}", "response INT, changes BIGINT, marked BOOLEAN, events BIGINT, seconds DOUBLE, visited BOOLEAN")
        self.kept = handle.getListState("kept", f"micros BIGINT, seq BIGINT, kind STRING, qid {self.question}, option INT, duration INT")

    def _settled(self, events: list[tuple], watermark: int) -> tuple[dict | None, dict, list[tuple]]:
        """The attempt and the questions of its events after what the watermark has passed, and the events left."""
        life = dict(zip(LIFE, self.life.get(), strict=True)) if self.life.exists() else None
        events.sort(key=lambda e: e[:2])
        questions = {}
        for qid in {e[3] for e in events if e[3] is not None}:
            if self.questions.containsKey((qid,)):
                questions[qid] = tuple(self.questions.getValue((qid,)))
        n = sum(e[0] <= watermark for e in events)
        before = dict(questions)
        for event in events[:n]:
            life = step(life, questions, event, self.most)
        if life is not None and life["ended"] is None and life["ends"] <= watermark:
            life = life | {"ended": life["ends"], "auto": True}
        if life is not None and life["ended"] is not None:
            self._finish(life, watermark)
        else:
            for qid, state in questions.items():
                if before.get(qid) != state:
                    self.questions.updateValue((qid,), state)
            if life is not None:
                self.life.update(tuple(life[k] for k in LIFE))
                self.handle.registerTimer(life["ends"] // 1000 + 1)
            if events[n:]:
                self.kept.put(events[n:])
                self.handle.registerTimer(events[-1][0] // 1000 + 1)
            elif n:
                self.kept.clear()
        return life, questions, events[n:]

    def _finish(self, life: dict, watermark: int) -> None:
        self.questions.clear()
        self.kept.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        gone = life["ended"] + self.linger
        if gone <= watermark:
            self.life.clear()
        else:
            self.life.update(tuple(life[k] for k in LIFE))
            self.handle.registerTimer(gone // 1000 + 1)

    def _rows(self, key, life: dict | None, questions: dict) -> pd.DataFrame:
        out = [(*key, qid, *state, None, None, None, None, None, None, None) for qid, state in questions.items()]
        if life is not None:
            used = None if life["ended"] is None else (life["ended"] - life["started"] + 500_000) // 1_000_000
            out.append((*key, None, *[None] * len(QUESTION), "in-progress" if life["ended"] is None else "submitted", life["started"], life["ends"], life["ended"], used, life["auto"], life["current"]))
        names = [c.split()[0] for c in OUT.split(", ")]
        rows = pd.DataFrame(out, columns=names, dtype=object)
        for c in ("started_at", "ends_at", "submitted_at"):
            rows[c] = pd.to_datetime(rows[c], unit="us", utc=True)
        return rows.astype({"seconds": "float64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.life.exists() and self.life.get()[2] is not None:
            for _ in rows:
                pass
            return
        events = [tuple(e) for e in self.kept.get()] if self.kept.exists() else []
        for part in rows:
            columns = [part[c].astype(object).where(part[c].notna(), None).tolist() for c in ("micros", "seq", "kind", "qid", "option", "duration_sec")]
            whole = [[v if v is None or isinstance(v, str) else int(v) for v in c] for c in columns]
            events += list(zip(*whole, strict=True))
        life, questions, left = self._settled(events, max(timerValues.getCurrentWatermarkInMs(), 0) * 1000)
        for event in left:
            life = step(life, questions, event, self.most)
        named = {e[3] for e in events if e[3] is not None}
        yield self._rows(key, life, {qid: questions.get(qid, BLANK) for qid in named})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        if self.life.exists() and (ended := self.life.get()[2]) is not None:
            if ended + self.linger <= watermark:
                self.life.clear()
            return
        events = [tuple(e) for e in self.kept.get()] if self.kept.exists() else []
        life, _, _ = self._settled(events, watermark)
        if life is not None and life["ended"] is not None:
            yield self._rows(key, life, {})

    def close(self) -> None:
        pass


def live_tests(log: DataFrame, delay: str = "10 minutes", most: float = MOST, linger: float = 86_400.0) -> DataFrame:
    """A stream of upserts by (attempt_id, qid) from a stream of logs; the row without a question is the attempt."""
    kinds = {c: log.schema[c].dataType.simpleString() for c in ("attempt_id", "qid")}
    timed = log.withColumn("event_time", F.col("event_time").cast("timestamp")).withColumn("micros", F.unix_micros("event_time")).withWatermark("event_time", delay)
    out = OUT.format(attempt=kinds["attempt_id"], question=kinds["qid"])
    return timed.groupBy("attempt_id").transformWithStateInPandas(statefulProcessor=LiveTest(kinds["qid"], most, linger), outputStructType=out, outputMode="Update", timeMode="EventTime")


def split_late(stream: DataFrame, folder: str, delay_sec: float, checkpoint: str) -> None:
    """Deal what has arrived of a log into rows in time and late ones; nothing gets lost.

    A row is late if the rows in time of earlier batches are more than delay_sec ahead of it, as for a watermark; so
    is a row without a time. A stateful stream over in_time() with a watermark of that delay drops nothing.
    Each batch is a folder of its own with its latest time beside it, so a repeated batch replaces itself.
    """
    spark = stream.sparkSession

    def deal(batch: DataFrame, number: int) -> None:
        tops = spark.read.schema("top TIMESTAMP, batch INT").parquet(f"{folder}/tops") if number else spark.createDataFrame([], "top TIMESTAMP, batch INT")
        limit = tops.where(F.col("batch") < number).agg(F.max("top").alias("top")).first()["top"]
        time = F.col("event_time").cast("timestamp")
        behind = F.lit(False) if limit is None else time <= F.timestamp_micros(F.unix_micros(F.lit(limit)) - F.lit(int(delay_sec * 1e6)))
        batch.withColumn("late", F.coalesce(behind & time.isNotNull() | time.isNull(), F.lit(False))).write.mode("overwrite").partitionBy("late").parquet(f"{folder}/rows/batch={number}")
        written = spark.read.schema(f"{_ddl(batch)}, late BOOLEAN").parquet(f"{folder}/rows/batch={number}")
        written.where("NOT late").agg(F.max(time).alias("top")).write.mode("overwrite").parquet(f"{folder}/tops/batch={number}")

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(deal).trigger(availableNow=True).start().awaitTermination()


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def in_time(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What split_late() found to be in time, as a stream."""
    return spark.readStream.schema(schema).parquet(f"{folder}/rows/batch=*/late=false")


def dealt(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows that split_late() has read, with batch and late."""
    return spark.read.schema(f"{schema}, batch INT, late BOOLEAN").option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/batch=*")
