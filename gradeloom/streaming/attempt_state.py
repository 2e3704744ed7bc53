"""The attempt state as a stream: events in, upserts of (attempt_id, qid) out."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from gradeloom.operators.records import apply_feed

#: What of an event reaches the state, as JSON: one text of it crosses to Python faster than its columns.
EVENT = ("micros", "seq", "kind", "qid", "option")
OUT = "attempt_id {attempt}, qid {question}, response INT, changes BIGINT, marked BOOLEAN, events BIGINT"
LIFE = "attempt_id {attempt}, status STRING, started_at TIMESTAMP, ends_at TIMESTAMP, submitted_at TIMESTAMP, time_used_sec INT, auto_submitted BOOLEAN, visited INT, current {question}, seconds DOUBLE, events BIGINT"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold(state: tuple, kind: str, option) -> tuple:
    """The state of one question after one event."""
    response, changes, marked, events = state
    if kind == "pick":
        if response == option:
            response = None
        else:
            changes += response is not None
            response = option
    elif kind == "clear":
        response = None
    elif kind == "mark":
        marked = True
    elif kind == "unmark" or (kind == "save" and response is not None):
        marked = False
    return response, changes, marked, events + 1


class AttemptState(StatefulProcessor):
    """Keeps events until the watermark has passed them, then folds them in order.

    One attempt is one key, whose questions and kept events are one value, so that its events cost few calls to
    the state. What is emitted after each batch is the fold of each question named in it, kept events included, so
    the last row of a question is right as soon as its events are there. A timer folds and forgets kept events of
    a quiet attempt.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "questions STRING, kept STRING")

    def _held(self) -> tuple[dict, list[list]]:
        """Questions (qid to what fold() takes) and kept events, lists by EVENT."""
        questions, kept = map(json.loads, self.state.get() or ("[]", "[]"))
        return {qid: tuple(state) for qid, *state in questions}, kept

    def _settle(self, questions: dict, rows: list[list], watermark_ms: int) -> dict:
        """The questions after all rows. Those that the watermark has passed count for good."""
        rows.sort(key=lambda r: r[:2])
        settled = sum(r[0] <= watermark_ms * 1000 for r in rows)
        kept = rows[settled:]
        _fold_all(questions, rows[:settled])
        self.state.update((json.dumps([(qid, *state) for qid, state in questions.items()]), json.dumps(kept)))
        if kept:
            self.handle.registerTimer(kept[-1][0] // 1000 + 1)
        _fold_all(questions, kept)
        return questions

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        questions, held = self._held()
        new = [[e.get(c) for c in EVENT] for e in json.loads(f"[{','.join(r.event for r in rows)}]")]
        questions = self._settle(questions, held + new, max(timerValues.getCurrentWatermarkInMs(), 0))
        for qid in dict.fromkeys(r[3] for r in new):
            response, changes, marked, events = questions[qid]
            yield Row(attempt_id=key[0], qid=qid, response=response, changes=changes, marked=marked, events=events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        questions, held = self._held()
        if held:
            self._settle(questions, held, timerValues.getCurrentWatermarkInMs())
        yield from ()

    def close(self) -> None:
        pass


def _fold_all(questions: dict, rows: list[list]) -> None:
    for _, _, kind, qid, option in rows:
        questions[qid] = fold(questions.get(qid, (None, 0, False, 0)), kind, option)


def _timed(log: DataFrame, delay: str) -> DataFrame:
    return log.withColumn("event_time", F.col("event_time").cast("timestamp")).withColumn("micros", F.unix_micros("event_time")).withWatermark("event_time", delay)


def _typed(schema: str, log: DataFrame) -> str:
    """The schema with the types that the log has for attempts and questions."""
    return schema.format(attempt=log.schema["attempt_id"].dataType.simpleString(), question=log.schema["qid"].dataType.simpleString())


def attempt_states(log: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of upserts from a stream of events; events later than delay are dropped."""
    timed = _timed(log, delay).select("attempt_id", "event_time", F.to_json(F.struct(*EVENT)).alias("event"))
    return timed.groupBy("attempt_id").transformWithState(statefulProcessor=AttemptState(), outputStructType=_typed(OUT, log), outputMode="Update", timeMode="EventTime")


NEW = {"started": None, "ends": None, "submitted": None, "auto": False, "seen": [], "current": None, "seconds": 0.0, "tick": None, "events": 0}


def live(state: dict, micros: int, kind: str, qid, duration, most: float = 5.0) -> dict:
    """An attempt after one event more; nothing has an effect after its end, which is its submission or its time.

    start sets the end, show a visit and the current question, a tick counts the seconds since the last one
    (most at a time, none over a start or a hidden stretch), submit ends a started attempt.
    """
    state = state | {"events": state["events"] + 1}
    if state["submitted"] is not None:
        return state
    if state["ends"] is not None and micros > state["ends"]:
        return state | {"submitted": state["ends"], "auto": True}
    if kind == "start" and state["started"] is None:
        return state | {"started": micros, "ends": micros + int(duration) * 1_000_000, "tick": None}
    if kind == "show" and qid is not None:
        return state | {"seen": sorted({*state["seen"], qid}), "current": qid}
    if kind == "tick":
        gained = 0.0 if state["tick"] is None else min(most, (micros - state["tick"]) / 1e6)
        return state | {"seconds": state["seconds"] + gained, "tick": micros}
    if kind in ("hide", "start"):
        return state | {"tick": None}
    if kind == "submit" and state["started"] is not None:
        return state | {"submitted": min(micros, state["ends"])}
    return state


class AttemptLife(StatefulProcessor):
    """Visits, time, submission and expiry of one attempt, folded as the watermark passes its events.

    What is emitted after each batch has the kept events included. A timer at the attempt's end submits it
    there if nobody has.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "state STRING")
        self.kept = handle.getListState("kept", "event STRING")

    def _settle(self, rows: list[list], watermark_ms: int) -> dict:
        state = json.loads(self.done.get()[0]) if self.done.exists() else NEW
        rows.sort(key=lambda r: r[:2])
        settled = [r for r in rows if r[0] <= watermark_ms * 1000]
        for micros, _, *event in settled:
            state = live(state, micros, *event)
        self.done.update((json.dumps(state),))
        kept = rows[len(settled) :]
        self.kept.put([(json.dumps(r),) for r in kept]) if kept else self.kept.clear()
        for micros, _, *event in kept:
            state = live(state, micros, *event)
        if state["submitted"] is None and state["ends"] is not None:
            self.handle.registerTimer(state["ends"] // 1000 + 1)
        elif kept:
            self.handle.registerTimer(kept[-1][0] // 1000 + 1)
        return state

    def _held(self) -> list[list]:
        return [json.loads(r[0]) for r in self.kept.get()] if self.kept.exists() else []

    def _row(self, key, state: dict) -> pd.DataFrame:
        at = {name: None if state[name] is None else pd.Timestamp(state[name], unit="us", tz="UTC") for name in ("started", "ends", "submitted")}
        used = None if state["submitted"] is None else (state["submitted"] - state["started"] + 500_000) // 1_000_000
        status = "submitted" if at["submitted"] else "in-progress" if at["started"] else "scheduled"
        row = (*key, status, at["started"], at["ends"], at["submitted"], used, state["auto"], len(state["seen"]), state["current"], state["seconds"], state["events"])
        names = ["attempt_id", "status", "started_at", "ends_at", "submitted_at", "time_used_sec", "auto_submitted", "visited", "current", "seconds", "events"]
        out = pd.DataFrame([row], columns=names).astype({"time_used_sec": "Int32", "visited": "int32"})
        for name in ("started_at", "ends_at", "submitted_at"):
            out[name] = pd.to_datetime(out[name], utc=True)
        return out.assign(current=pd.Series([state["current"]], dtype=object))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        for part in rows:
            columns = [part[c].astype(object).where(part[c].notna(), None).tolist() for c in ("micros", "seq", "kind", "qid", "duration_sec")]
            held += [[int(m), int(s), kind, q if q is None or isinstance(q, str) else int(q), None if d is None else int(d)] for m, s, kind, q, d in zip(*columns, strict=True)]
        yield self._row(key, self._settle(held, max(timerValues.getCurrentWatermarkInMs(), 0)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        state = self._settle(self._held(), now)
        if state["submitted"] is None and state["ends"] is not None and state["ends"] <= now * 1000:
            state = state | {"submitted": state["ends"], "auto": True}
            self.done.update((json.dumps(state),))
            yield self._row(key, state)

    def close(self) -> None:
        pass


def attempt_lives(log: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of upserts, a row for each attempt, from a log with duration_sec (given at its start)."""
    return _timed(log, delay).groupBy("attempt_id").transformWithStateInPandas(statefulProcessor=AttemptLife(), outputStructType=_typed(LIFE, log), outputMode="Update", timeMode="EventTime")


def run_available(stream: DataFrame, folder: str, key: tuple[str, ...] = ("attempt_id", "qid"), last: tuple[str, ...] = ("events",), work: str | None = None, told: list | None = None) -> DataFrame:
    """Run a stream of upserts over what is available; returns the last row of each key.

    Every batch is a folder named by its number, so a repeated batch replaces itself. Of rows of a key in one
    batch that with the greatest `last` columns counts. With work, a folder, a later run goes on where an
    earlier one ended; told gets the progress of each batch.
    """
    spark = stream.sparkSession
    work = work or f"{folder}/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{work}/out/batch={number}/rows")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{work}/state").foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination()
        if told is not None:
            told += query.recentProgress
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    rows = spark.read.schema(StructType([*stream.schema, StructField("batch", IntegerType())])).parquet(f"{work}/out/*/rows")
    order = Window.partitionBy(*key).orderBy(F.desc("batch"), *(F.desc_nulls_last(c) for c in last))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "batch")


def watch(stream: DataFrame, read_table, write_table, key: str, checkpoint: str):
    """Start a query that merges each batch of a change feed into a versioned table."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: write_table(apply_feed(read_table(batch.sparkSession), batch, key))).start()


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
