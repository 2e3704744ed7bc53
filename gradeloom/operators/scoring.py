"""Scoring of attempts and the statistics of a performance report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.numbers import cents, half_up, percent
from gradeloom.functions.text import numbered_paragraph, question_type
from gradeloom.sources.scratch import stored


def score_rows(items: DataFrame, questions: DataFrame) -> DataFrame:
    """Items of questions that still exist, with their status, rounded time and question type.

    questions needs qid, answer and text; with stem, numbered paragraphs count for the type, too. The type is
    found once for each question, before the join.
    unscored without a key, else skipped without a response, else correct or wrong. idx keeps its gaps.
    """
    numbered = numbered_paragraph(F.col("stem")) if "stem" in questions.columns else None
    keyed = questions.select("qid", "answer", question_type(F.col("text"), numbered).alias("type"))
    status = (
        F.when(F.col("answer").isNull(), "unscored").when(F.col("resp").isNull(), "skipped")
        .when(F.col("resp") == F.col("answer"), "correct").otherwise("wrong")
    )
    time = half_up(F.coalesce("time_s", F.lit(0.0)))
    return items.join(keyed, "qid").withColumns({"status": status, "time": time, "changes": F.coalesce("changes", F.lit(0))})


def _n(condition: Column | str) -> Column:
    return F.count_if(F.expr(condition) if isinstance(condition, str) else condition)


def totals(rows: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row for each attempt: counts, score, max, accuracy, attempted, percent, marks gained and lost."""
    count = rows.groupBy("attempt_id").agg(*(_n(f"status = '{s}'").alias(s) for s in ("correct", "wrong", "skipped", "unscored")), _n("resp IS NOT NULL").alias("attempted"))
    out = count.join(attempts.select("attempt_id", "plus", "minus"), "attempt_id")
    c, w, s = F.col("correct"), F.col("wrong"), F.col("skipped")
    out = out.withColumns({
        "score": cents(c * F.col("plus") - w * F.col("minus")), "max": cents((c + w + s) * F.col("plus")), "accuracy": percent(c, c + w),
        "gained": cents(c * F.col("plus")), "lost": cents(w * F.col("minus")),
    })
    return out.withColumn("percent", F.when(F.col("max") != 0, half_up(F.col("score") / F.col("max") * 1000) / F.lit(10.0))).drop("plus", "minus")


def changed_questions(before: DataFrame, after: DataFrame) -> DataFrame:
    """qid of the questions that one key has and the other lacks, or whose answers differ."""
    a, b = before.select("qid", F.struct("answer").alias("a")), after.select("qid", F.struct("answer").alias("b"))
    return a.join(b, "qid", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("qid").distinct()


def rescore(scores: DataFrame, items: DataFrame, attempts: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """totals() after the questions before became those after, from the stored totals before.

    Only attempts with a changed question are scored anew, so what is read of items in full and joined are theirs;
    all other totals stay. Attempts none of whose questions are left have no row, as in totals().
    """
    touched = items.join(changed_questions(before, after), "qid", "left_semi").select("attempt_id").distinct()
    touched = stored(touched, "touched")
    own = items.join(touched, "attempt_id", "left_semi")
    return scores.join(touched, "attempt_id", "left_anti").unionByName(totals(score_rows(own, after), attempts).select(scores.columns))


def time_and_review(rows: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row for each attempt: time statistics, marked, changed and unvisited questions, time used."""

    def mean(condition: str) -> Column:
        return half_up(F.avg(F.when(F.expr(condition), F.col("time"))))

    stats = rows.groupBy("attempt_id").agg(
        F.bool_or(F.col("time") > 0).alias("tracked"), mean("resp IS NOT NULL").alias("per_answered"), mean("status = 'correct'").alias("per_correct"),
        mean("status = 'wrong'").alias("per_wrong"), _n("time > 120").alias("over_2min"), F.greatest(F.lit(0), F.max("time")).alias("max_time"),
        _n("marked").alias("marked_total"), _n("marked AND status = 'correct'").alias("marked_correct"), _n("marked AND status = 'wrong'").alias("marked_wrong"), _n("marked AND resp IS NULL").alias("marked_blank"),
        _n("changes > 0").alias("changed_total"), _n("changes > 0 AND status = 'correct'").alias("changed_correct"), _n("changes > 0 AND status = 'wrong'").alias("changed_wrong"), _n("NOT visited").alias("not_visited"),
    )
    gap = F.unix_micros(F.col("submitted_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    used = F.coalesce(F.col("time_used_sec"), half_up(gap / 1_000_000)).cast("long")
    return stats.join(attempts.select("attempt_id", used.alias("time_used")), "attempt_id")


def by_type(rows: DataFrame) -> DataFrame:
    """attempt_id, type, counts, accuracy, avg_time, place: most questions first, ties by first appearance."""
    out = rows.groupBy("attempt_id", "type").agg(
        F.count(F.lit(1)).alias("total"), *(_n(f"status = '{s}'").alias(s) for s in ("correct", "wrong", "skipped", "unscored")),
        half_up(F.sum("time") / F.count(F.lit(1))).alias("avg_time"), F.min("idx").alias("first_idx"),
    )
    order = Window.partitionBy("attempt_id").orderBy(F.desc("total"), "first_idx")
    return out.withColumns({"accuracy": percent(F.col("correct"), F.col("correct") + F.col("wrong")), "place": F.row_number().over(order)}).drop("first_idx")


def slowest(rows: DataFrame, k: int = 5) -> DataFrame:
    """The k questions of each attempt that took longest, among those that took any time; ties by order."""
    order = Window.partitionBy("attempt_id").orderBy(F.desc("time"), "idx")
    return rows.where("time > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("attempt_id", "place", "qid", "idx", "time")


def history(scored: DataFrame, attempts: DataFrame, owner: str = "student_id") -> DataFrame:
    """Submitted attempts of each owner by time, scored with the current key; latest first as place 1."""
    done = attempts.where("status = 'submitted'").join(scored.select("attempt_id", "score", "max", "accuracy", "attempted"), "attempt_id")
    order = Window.partitionBy(owner).orderBy("submitted_at", "attempt_id")
    back = Window.partitionBy(owner).orderBy(F.desc("submitted_at"), F.desc("attempt_id"))
    return done.select(owner, "attempt_id", "submitted_at", "score", "max", "accuracy", "attempted", "time_used_sec", F.row_number().over(order).alias("number"), F.row_number().over(back).alias("from_last"))


def latest(scored: DataFrame, attempts: DataFrame, owner: str = "student_id", k: int = 4) -> DataFrame:
    """The k latest submitted attempts of each owner with their scores; only they are joined to scores."""
    back = Window.partitionBy(owner).orderBy(F.desc("submitted_at"), F.desc("attempt_id"))
    few = attempts.where("status = 'submitted'").withColumn("place", F.row_number().over(back)).where(F.col("place") <= k)
    return few.join(scored, "attempt_id").select(owner, "place", "attempt_id", "score", "max")


def live(attempts: DataFrame, owner: str = "student_id") -> DataFrame:
    """For each owner the first attempt in progress, and the scheduled ones by start (null first)."""
    order = Window.partitionBy(owner, "status").orderBy(F.coalesce(F.unix_micros(F.col("started_at").cast("timestamp")), F.lit(0)), "attempt_id")
    rows = attempts.where("status IN ('in-progress', 'scheduled')").withColumn("place", F.row_number().over(order))
    return rows.where("status = 'scheduled' OR place = 1").select(owner, "status", "place", "attempt_id", "started_at")


def palette(items: DataFrame) -> DataFrame:
    """Counts of each attempt's question palette: mark and answered, mark, answered, seen, idle."""
    state = (
        F.when(F.col("marked") & F.col("resp").isNotNull(), "markdone").when(F.col("marked"), "mark")
        .when(F.col("resp").isNotNull(), "done").when(F.col("visited"), "seen").otherwise("idle")
    )
    wide = items.groupBy("attempt_id").agg(*(F.count_if(state == s).alias(s) for s in ("done", "seen", "idle", "mark", "markdone")))
    return wide


def review(rows: DataFrame, keep: str = "all") -> DataFrame:
    """Rows of one filter (a status, 'marked', 'changed' or 'all'), with places by test order and by time."""
    kept = {"all": "true", "marked": "marked", "changed": "changes > 0"}.get(keep, f"status = '{keep}'")
    one = rows.where(kept)
    return one.withColumns({
        "by_order": F.row_number().over(Window.partitionBy("attempt_id").orderBy("idx")),
        "by_time": F.row_number().over(Window.partitionBy("attempt_id").orderBy(F.desc("time"), "idx")),
    }).select("attempt_id", "qid", "status", "time", "by_order", "by_time")


def shuffled(items: DataFrame, seed: str) -> DataFrame:
    """A new order of each attempt's questions, the same whenever the seed is."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("attempt_id").cast("string"), F.col("qid").cast("string")))
    return items.select("attempt_id", "qid", (F.row_number().over(Window.partitionBy("attempt_id").orderBy(key, "qid")) - 1).alias("place"))
