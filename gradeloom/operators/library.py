"""Papers, their catalog, and record stores as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.functions.numbers import half_up
from gradeloom.functions.text import trimmed
from gradeloom.sources.exam_tables import STEM

QUESTION = "id STRING, num INT, stem ARRAY<STRUCT<type: STRING, text: STRING, rows: ARRAY<ARRAY<STRING>>>>, options ARRAY<STRING>, answer INT, warnings ARRAY<STRING>"
PAPER = f"id STRING, title STRING, note STRING, pageCount INT, keySource STRING, questions ARRAY<STRUCT<{QUESTION.replace('id STRING', 'id: STRING').replace('num INT', 'num: INT').replace('stem ARRAY', 'stem: ARRAY').replace('options ARRAY', 'options: ARRAY').replace('answer INT', 'answer: INT').replace('warnings ARRAY', 'warnings: ARRAY')}>>"


def upsert(table: DataFrame, changes: DataFrame, key: str, version: Column) -> DataFrame:
    """Last write wins: for each key the row of highest version, changes before the table on a tie."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(key).orderBy(version.desc_nulls_last(), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def remove(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the removed ones; used for a table and its children (cascade)."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Paper documents (JSON, one a file) with a row for each question."""
    papers = spark.read.schema(PAPER).json(path, multiLine=True)
    return papers.select(F.col("id").alias("paper_id"), "title", F.posexplode_outer("questions").alias("pos", "q")).select("paper_id", "title", "pos", "q.*")


def write_papers(papers: DataFrame, path: str) -> None:
    """Paper rows as JSON, one folder for each paper, so a later write replaces only the papers it has."""
    papers.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("paper_id").json(path)


def question_text(num: Column, stem: Column, options: Column) -> Column:
    """A question as plain lines: number and stem, then (a), (b) and so on."""
    lines = F.transform(options, lambda o, i: F.concat(F.lit("   ("), F.substring(F.lit("abcde"), i + 1, F.lit(1)), F.lit(") "), o))
    return F.concat_ws("\n", F.concat_ws(". ", num.cast("string"), stem), F.array_join(lines, "\n"))


def keyed_counts(questions: DataFrame) -> DataFrame:
    """For each paper: questions, keyed ones, those without a key, and those with warnings (array<string>)."""
    return questions.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("questions"), F.count("answer").alias("keyed"), F.count_if(F.col("answer").isNull()).alias("no_key"), F.count_if(F.size("warnings") > 0).alias("flagged"),
    )


def range_selection(questions: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """For each paper: questions numbered from first to last (by default its own), and how many of them have no key."""
    kept = questions.where(F.lit(True) if first is None else F.col("num") >= first).where(F.lit(True) if last is None else F.col("num") <= last)
    return kept.groupBy("paper_id").agg(F.count(F.lit(1)).alias("chosen"), F.count_if(F.col("answer").isNull()).alias("no_key"))


def low_text(chars: Column, pages: Column, least: int = 40) -> Column:
    """Whether a paper has fewer characters than `least` for each of its pages: nothing to read."""
    return chars < least * pages


# Fixed value: names of scanning and recognition programs.
SCANNERS = "(?i)omnipage|abbyy|tesseract|finereader|scan|ocr"


def scanned(low_quality: Column, *programs: Column) -> Column:
    """Whether a paper is a scan: options that cannot be read, or a producer or creator that scans. Null names none."""
    named = [F.coalesce(p.rlike(SCANNERS), F.lit(False)) for p in programs]
    return reduce(Column.__or__, named, F.coalesce(low_quality, F.lit(False)))


def source_papers(questions: DataFrame) -> DataFrame:
    """For each paper: its keyed questions, and how many other papers have any and so can give it answers.

    The other papers are the same for all but themselves, so they are counted, not listed for each paper.
    """
    own = questions.groupBy("paper_id").agg(F.count("answer").alias("keyed"))
    able = own.where("keyed > 0").count()
    return own.select("paper_id", "keyed", (F.lit(able) - (F.col("keyed") > 0).cast("int")).cast("long").alias("others"))


def in_library(catalog: DataFrame, papers: DataFrame, key: str = "catalog_id") -> DataFrame:
    """Catalog rows with the user's first paper of the same catalog id, null where there is none."""
    return catalog.join(papers.groupBy(key).agg(F.min("paper_id").alias("paper")), key, "left")


def text_of_stem(stem: Column) -> Column:
    """A stem as lines to edit: a paragraph a line, a table row as cells between ' | '."""
    rows = lambda b: F.when(b["type"] == "p", F.array(F.coalesce(b["text"], F.lit("")))).otherwise(F.transform(b["rows"], lambda r: F.array_join(r, " | ")))
    return F.array_join(F.flatten(F.transform(stem, rows)), "\n")


def stem_of_text(text: Column) -> Column:
    """The stem that edited lines mean: rows with ' | ' one after another are a table, other lines paragraphs; blank lines go."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), trimmed), lambda x: x != "")
    cells = lambda x: F.transform(F.split(x, r"\|"), trimmed)

    def add(blocks: Column, line: Column) -> Column:
        row, last = F.contains(line, F.lit(" | ")), F.try_element_at(blocks, F.lit(-1))
        more = F.struct(F.lit("table").alias("type"), F.lit(None).cast("string").alias("text"), F.concat(last["rows"], F.array(cells(line))).alias("rows"))
        new = F.struct(F.when(row, "table").otherwise("p").alias("type"), F.when(~row, line).alias("text"), F.when(row, F.array(cells(line))).alias("rows"))
        joined = row & F.coalesce(last["type"] == "table", F.lit(False))
        return F.when(joined, F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(more))).otherwise(F.concat(blocks, F.array(new)))

    return F.aggregate(lines, F.array().cast(STEM), lambda a, x: add(a, x).cast(STEM))


def edit_questions(questions: DataFrame, edits: DataFrame) -> DataFrame:
    """Questions with the edited stem and options of edits (qid, stem_text, options_text): one row a question.

    Options are the lines that are not blank, five at most; an answer beyond them is lost; fewer than two
    options are warned of, and other warnings of the question go.
    """
    rows = questions.join(edits, "qid", "left")
    options = F.slice(F.filter(F.transform(F.split("options_text", "\r?\n"), trimmed), lambda o: o != ""), 1, 5)
    edited = F.col("options_text").isNotNull()
    rows = rows.withColumn("options", F.when(edited, options).otherwise(F.col("options")))
    few = F.when(F.size("options") < 2, F.array(F.lit("Fewer than two options."))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({
        "stem": F.when(F.col("stem_text").isNotNull(), stem_of_text(F.col("stem_text"))).otherwise(F.col("stem")), "warnings": F.when(edited, few).otherwise(F.col("warnings")),
        "answer": F.when(F.col("answer") < F.size("options"), F.col("answer")),
    }).drop("stem_text", "options_text")


def default_minutes(questions: Column) -> Column:
    """Eight tenths of a minute a question, five at least."""
    return F.greatest(F.lit(5).cast("long"), half_up(questions * 0.8))


#: Marks for a right answer and taken off for a wrong one where a paper says nothing else.
PLUS, MINUS = 1.0, 0.33


def with_settings(papers: DataFrame) -> DataFrame:
    """Papers (paper_id, questions, and perhaps minutes, plus, minus) with defaults for settings that are null or absent."""
    default = {"minutes": default_minutes(F.col("questions")), "plus": F.lit(PLUS), "minus": F.lit(MINUS)}
    return papers.withColumns({name: F.coalesce(F.col(name), value) if name in papers.columns else value for name, value in default.items()})


def cards(questions: DataFrame, attempts: DataFrame, paper: str = "paper_id") -> DataFrame:
    """For each paper: questions, keyed ones, default minutes, and attempts by status."""
    q = questions.groupBy(paper).agg(F.count(F.lit(1)).alias("questions"), F.count("answer").alias("keyed"))
    a = attempts.groupBy(paper).agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in (("submitted", "submitted"), ("in-progress", "in_progress"), ("scheduled", "scheduled"))))
    out = q.join(a, paper, "left").na.fill(0, ["submitted", "in_progress", "scheduled"])
    return out.withColumn("minutes", default_minutes(F.col("questions")))


def missing_numbers(questions: DataFrame) -> DataFrame:
    """Numbers between a paper's first and last question that no question has."""
    span = questions.groupBy("paper_id").agg(F.min("num").alias("a"), F.max("num").alias("b")).where("b > a")
    every = span.select("paper_id", F.explode(F.sequence("a", "b")).alias("num"))
    return every.join(questions.select("paper_id", "num"), ["paper_id", "num"], "left_anti")


def key_text_from_items(items: DataFrame) -> DataFrame:
    """(doc_id, text): items into rows by baseline (steps of 4) and x, rows into lines, pages one after another."""
    row = items.groupBy("doc_id", "page", half_up(F.col("baseline") / 4).alias("row")).agg(F.array_sort(F.collect_list(F.struct("x", "item_no", "str"))).alias("e"))
    line = row.select("doc_id", "page", "row", F.array_join(F.col("e.str"), " ").alias("line"))
    doc = line.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "row", "line"))).alias("e"))
    return doc.select("doc_id", F.array_join(F.col("e.line"), "\n").alias("text"))
