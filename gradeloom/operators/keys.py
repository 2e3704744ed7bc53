"""Answer keys: read from free text, written as text, and applied to questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.functions.text import SPACES, label_index, let, trimmed

# Fixed value: a question number and the label after it, with white space of any script between.
PAIR = r"(?:^|[^\w(])Q?\.?\s*(\d{1,3})\s*[.):\-=–]?\s*\(?\s*([a-eA-E1-5])\s*\)?(?![\w])".replace(r"\s", SPACES)
#: What stands between the cells of a table, and between the labels of a sequence.
CELLS, LABELS = (f"[{SPACES[1:-1]}{more}]+" for more in (",|", ",;|"))
KEY = "array<struct<num:int,idx:int>>"


def _first(entries: Column) -> Column:
    """Of entries with one number only the first."""
    numbers = F.transform(entries, lambda e: e["num"])
    return F.filter(entries, lambda e, i: F.array_position(numbers, e["num"]) == i + 1)


def _entry(num: Column, label: Column) -> Column:
    return F.struct(num.cast("int").alias("num"), label_index(label).cast("int").alias("idx"))


def read_pairs(text: Column) -> Column:
    """'1-a, 2.(b), Q3: 4': the first label of each number above 0."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(PAIR), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(PAIR), F.lit(2)).alias("l"))
    return _first(F.filter(F.transform(both, lambda p: _entry(p["n"], p["l"])), lambda e: e["num"] > 0))


def read_tabular(text: Column) -> Column:
    """A line of two or more numbers, then a line of as many letters; later tables overrule earlier ones."""
    lines = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: x != "")

    def table(line: Column, below: Column) -> Column:
        nums = F.split(line, CELLS)
        labels = F.transform(F.split(F.coalesce(below, F.lit("")), CELLS), lambda x: F.regexp_replace(x, "[()]", ""))
        fits = (F.size(nums) >= 2) & (F.size(nums) == F.size(labels)) & F.forall(nums, lambda n: n.rlike(r"^\d{1,3}$")) & F.forall(labels, lambda x: x.rlike("^[a-eA-E]$"))
        return F.when(fits, F.zip_with(nums, labels, _entry)).otherwise(F.array().cast(KEY))

    tables = let(lines, lambda rows: F.flatten(F.zip_with(rows, F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), table)))
    return let(F.reverse(tables), lambda found: F.reverse(_first(found)))


def read_sequence(text: Column) -> Column:
    """A run of three or more letters, or only labels, for questions 1, 2, 3 and so on."""
    tokens = F.filter(F.split(text, LABELS), lambda t: t != "")
    alone = (F.size(tokens) == 1) & F.element_at(tokens, 1).rlike("^[a-eA-E]{3,}$")
    several = (F.size(tokens) > 1) & F.forall(tokens, lambda t: t.rlike(r"^\(?[a-eA-E1-5]\)?$"))
    bare = F.transform(tokens, lambda t: F.regexp_replace(t, "[()]", ""))
    labels = F.when(alone, F.regexp_extract_all(text, F.lit("[a-eA-E]"), F.lit(0))).when(several, bare).otherwise(F.array().cast("array<string>"))
    return F.transform(labels, lambda x, i: _entry(i + 1, x))


def read_key(text: Column, reader: str = "largest") -> Column:
    """array<struct<num, idx>> of a key text: one reader's, or the largest reading.

    Of equally large ones tabular precedes sequence precedes pairs. Null and blank texts have no key.
    Beware: a table of the numbers 1 to 5 alone is also a longer sequence; reader='tabular' avoids that.
    """
    text = F.coalesce(text, F.lit(""))
    readings = {"tabular": read_tabular(text), "sequence": read_sequence(text), "pairs": read_pairs(text)}
    if reader != "largest":
        return readings[reader]
    t, s, p = readings.values()
    return F.when((F.size(t) >= F.size(s)) & (F.size(t) >= F.size(p)), t).when(F.size(s) >= F.size(p), s).otherwise(p)


def key_rows(texts: DataFrame, reader: str = "largest", paper: str = "paper_id", text: str = "text") -> DataFrame:
    """(paper, num, idx) of key texts, one a row; nothing is shuffled."""
    return texts.select(paper, F.inline(read_key(F.col(text), reader)))


def format_key(questions: DataFrame) -> DataFrame:
    """(paper_id, text): '1-3, 2-1' in question order, labels from 1; keyed questions only."""
    one = F.struct("pos", F.concat_ws("-", "num", F.col("answer") + 1).alias("s"))
    rows = questions.where("answer IS NOT NULL").groupBy("paper_id").agg(F.array_sort(F.collect_list(one)).alias("e"))
    return rows.select("paper_id", F.array_join(F.col("e.s"), ", ").alias("text"))


def apply_key(questions: DataFrame, key: DataFrame) -> DataFrame:
    """Questions with the key's answers where it has their number; of a repeated number only the last gets one.

    Of several key rows for one number the least label counts.
    """
    last = Window.partitionBy("paper_id", "num")
    rows = questions.withColumn("_last", F.max("pos").over(last) == F.col("pos"))
    rows = rows.join(key.groupBy("paper_id", "num").agg(F.min("idx").alias("_idx")), ["paper_id", "num"], "left")
    return rows.withColumn("answer", F.when(F.col("_last"), F.coalesce("_idx", "answer")).otherwise(F.col("answer"))).drop("_last", "_idx")


def unknown_numbers(questions: DataFrame, key: DataFrame) -> DataFrame:
    """Key rows without a question."""
    return key.join(questions, ["paper_id", "num"], "left_anti").select("paper_id", "num")


def copy_answers(questions: DataFrame, copied: DataFrame, mode: str = "overwrite") -> DataFrame:
    """Questions with copied (qid, idx): over their own answers, or with mode='fill' only where they have none.

    Of several copies for one question the least label counts.
    """
    rows = questions.join(copied.groupBy("qid").agg(F.min("idx").alias("_idx")), "qid", "left")
    pair = ("_idx", "answer") if mode == "overwrite" else ("answer", "_idx")
    return rows.withColumn("answer", F.coalesce(*pair)).drop("_idx")


def toggle_answers(questions: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply edits (qid, seq, option) in turn: the answer becomes the option, or none where it was that already.

    Edits of one question are folded in the order of seq; an edit without an option changes nothing.
    """
    own = edits.where("option IS NOT NULL").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("seq", "option"))).alias("_edits"))
    rows = questions.join(own, "qid", "left")
    new = F.aggregate("_edits", F.col("answer"), lambda a, e: F.when(a.eqNullSafe(e["option"].cast(questions.schema["answer"].dataType)), F.lit(None)).otherwise(e["option"]).cast(questions.schema["answer"].dataType))
    return rows.withColumn("answer", F.when(F.col("_edits").isNull(), F.col("answer")).otherwise(new)).drop("_edits")


def apply_printed_key(questions: DataFrame, key_texts: DataFrame) -> DataFrame:
    """Questions of papers (doc_id, num, pos, answer) with the key that their paper prints (doc_id, text) over inline answers."""
    key = key_rows(key_texts, paper="doc_id").withColumnRenamed("doc_id", "paper_id")
    return apply_key(questions.withColumnRenamed("doc_id", "paper_id"), key).withColumnRenamed("paper_id", "doc_id")


def read_key_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the .txt and .csv key files below a folder, each read whole; quotes fall away."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    plain = F.regexp_replace(F.regexp_replace("text", "\\r\\n?", "\n"), '"', "")
    return raw.where(F.lower("path").rlike(r"\.(?:txt|csv)\z")).select("path", plain.alias("text"))
