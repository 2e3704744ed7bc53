"""Registered queries on answer keys and the paper library, with the SQL they are compared with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import keys as K
from gradeloom.operators import library as L
from gradeloom.operators import records as R
from gradeloom.operators.records import apply_feed, present
from gradeloom.sources import exam_tables as T
from gradeloom.sources.exam_tables import with_tables
from gradeloom.sources.scratch import scratch


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.questions(spark, sf_dir).select("paper_id", "qid", "num", "pos", "text", "options", "answer")


def _key(spark, sf_dir) -> DataFrame:
    """A key with sixty numbers for each paper, so that some have no question."""
    papers = T.questions(spark, sf_dir).select("paper_id").distinct()
    return papers.select("paper_id", F.explode(F.sequence(F.lit(1), F.lit(60), F.lit(3))).alias("num")).withColumn("idx", ((F.col("paper_id") + F.col("num") * 7) % 5).cast("int"))


def format_keys(spark, sf_dir):
    """The key text of every paper."""
    return K.format_key(_questions(spark, sf_dir))


def _pasted(texts: DataFrame) -> DataFrame:
    """Key texts, every third with no-break spaces as pages paste them, every third with wide ones."""
    third = F.col("paper_id") % 3
    return texts.withColumn("text", F.replace(F.col("text"), F.lit(" "), F.when(third == 1, F.lit("\u00a0")).when(third == 2, F.lit("\u2003")).otherwise(F.lit(" "))))


def read_pair_keys(spark, sf_dir):
    """Keys written as pairs and read again."""
    return K.key_rows(_pasted(format_keys(spark, sf_dir)))


def read_tabular_keys(spark, sf_dir):
    """Keys written as tables of ten and read again."""
    q = _questions(spark, sf_dir).where("answer IS NOT NULL")
    row = q.groupBy("paper_id", F.floor(F.col("pos") / 10).alias("r")).agg(F.array_sort(F.collect_list(F.struct("num", F.substring(F.lit("abcde"), F.col("answer") + 1, F.lit(1)).alias("l")))).alias("e"))
    row = row.where(F.size("e") > 1).select("paper_id", "r", F.concat(F.array_join(F.col("e.num").cast("array<string>"), " "), F.lit("\n"), F.array_join(F.transform("e", lambda e: F.concat(F.lit("("), e["l"], F.lit(")"))), " | ")).alias("t"))
    text = row.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("r", "t"))).alias("e")).select("paper_id", F.array_join(F.col("e.t"), "\n\n").alias("text"))
    return K.key_rows(_pasted(text))


def read_sequence_keys(spark, sf_dir):
    """Keys written as a run of letters and read again."""
    q = _questions(spark, sf_dir).where("answer IS NOT NULL")
    e = q.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("num", F.substring(F.lit("ABCDE"), F.col("answer") + 1, F.lit(1)).alias("l")))).alias("e"))
    apart = F.when(F.col("paper_id") % 2 == 0, "").otherwise(" ")
    return K.key_rows(_pasted(e.select("paper_id", F.array_join(F.array_compact(F.flatten(F.transform("e.l", lambda x: F.array(x, apart)))), "").alias("text"))))


def apply_key(spark, sf_dir):
    """Questions with a key's answers by number."""
    return K.apply_key(_questions(spark, sf_dir), _key(spark, sf_dir)).select("paper_id", "qid", "num", "answer")


def unknown_key_numbers(spark, sf_dir):
    """Key numbers without a question."""
    return K.unknown_numbers(_questions(spark, sf_dir), _key(spark, sf_dir))


def _copied(spark, sf_dir) -> DataFrame:
    p = T.read(spark, sf_dir, "part")
    return p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("qid"), (F.col("p_partkey") % 4).cast("int").alias("idx"))


def copy_answers_overwrite(spark, sf_dir):
    """Copied answers over a paper's own."""
    return K.copy_answers(_questions(spark, sf_dir), _copied(spark, sf_dir)).select("qid", "answer")


def copy_answers_fill(spark, sf_dir):
    """Copied answers where a paper has none."""
    return K.copy_answers(_questions(spark, sf_dir), _copied(spark, sf_dir), "fill").select("qid", "answer")


def toggle_answers(spark, sf_dir):
    """Single answer edits; the same option twice clears it. Every ninth question is edited twice."""
    one = _copied(spark, sf_dir).select("qid", F.lit(1).alias("seq"), F.col("idx").alias("option"))
    edits = one.unionByName(one.where("qid % 9 = 0").select("qid", F.lit(2).alias("seq"), ((F.col("option") + F.col("qid") % 2) % 4).cast("int").alias("option")))
    return K.toggle_answers(_questions(spark, sf_dir), edits).select("qid", "answer")


def clear_paper_key(spark, sf_dir):
    """Every answer of the even papers cleared, their last questions removed."""
    q = _questions(spark, sf_dir)
    gone = q.where("paper_id % 2 = 0 AND num = 50")
    return L.remove(q, gone, "qid").withColumn("answer", F.when(F.col("paper_id") % 2 != 0, F.col("answer"))).select("qid", "answer")


def keyed_counts(spark, sf_dir):
    """Questions, keyed, without key and flagged ones of every paper."""
    q = _questions(spark, sf_dir).withColumn("warnings", F.filter(F.array(F.when(F.length("text") > 60, "long stem"), F.when(F.col("answer").isNull(), "no key")), lambda w: w.isNotNull()))
    return L.keyed_counts(q)


def range_selection(spark, sf_dir):
    """Questions 11 to the last of every paper, and how many have no key."""
    return L.range_selection(_questions(spark, sf_dir), first=11)


def missing_numbers(spark, sf_dir):
    """Numbers that are missing where a third of the questions is lost."""
    return L.missing_numbers(_questions(spark, sf_dir).where("qid % 3 != 0"))


def source_papers(spark, sf_dir):
    """For every paper its keyed questions and how many others can give it answers; every third paper has no key."""
    q = _questions(spark, sf_dir).withColumn("answer", F.when(F.col("paper_id") % 3 != 0, F.col("answer")))
    return L.source_papers(q)


def _paper_attempts(spark, sf_dir) -> DataFrame:
    return T.attempts(spark, sf_dir).withColumn("paper_id", F.col("attempt_id") % 50)


def library_cards(spark, sf_dir):
    """Question, key and attempt counts of every paper with its default minutes."""
    return L.cards(_questions(spark, sf_dir), _paper_attempts(spark, sf_dir))


def cascade_delete(spark, sf_dir):
    """Attempts that stay when the papers of a prefix of the catalog are deleted with their attempts."""
    gone = T.questions(spark, sf_dir).where("paper_id % 7 = 3").select("paper_id").distinct()
    return L.remove(_paper_attempts(spark, sf_dir), gone, "paper_id").groupBy("paper_id").agg(F.count(F.lit(1)).alias("attempts"))


def catalog_in_library(spark, sf_dir):
    """Catalog rows with the user's first paper of the same catalog id, if any."""
    catalog = T.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("catalog_id"), "c_name")
    own = T.attempts(spark, sf_dir).select(F.col("student_id").alias("catalog_id"), F.col("attempt_id").alias("paper_id"))
    return L.in_library(catalog, own)


def upsert_records(spark, sf_dir):
    """Last write wins between a store of orders and changes to a fifth of them."""
    o = T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), F.lit(1).alias("version"))
    new = o.where("id % 5 = 0").select("id", F.round(F.col("value") * 2, 2).alias("value"), (F.lit(2) - (F.col("id") % 10 == 0).cast("int") * 2).alias("version"))
    return L.upsert(o, new, "id", F.col("version"))


def low_text_documents(spark, sf_dir):
    """Documents with less than 40 characters for each of their pages (one to ten, by id)."""
    d = T.read(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars"), (F.col("doc_id") % 10 + 1).alias("pages"))
    return d.where(L.low_text(F.col("chars"), F.col("pages"))).select("doc_id", "chars")


def scanned_flags(spark, sf_dir):
    """Pages whose address or markup names a scanning or recognition program, or that are marked as hardly readable."""
    p = T.read(spark, sf_dir, "pages")
    return p.select("page_id", L.scanned(F.col("page_id") % 11 == 0, F.col("url"), F.col("html")).alias("scanned"))


def question_lines(spark, sf_dir):
    """Every question as plain text."""
    q = _questions(spark, sf_dir)
    return q.select("qid", L.question_text(F.col("num"), F.col("text"), F.col("options")).alias("lines"))


def _items(spark, sf_dir) -> DataFrame:
    """Positioned items from lineitem and part: a document a supplier."""
    i = T.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").distinct()
    p = T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return i.join(p, "l_partkey").select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page"), (F.col("l_partkey") % 560).cast("double").alias("x"), (F.col("l_quantity") * 2).alias("w"),
        (40 + 18 * (F.col("l_orderkey") % 40)).cast("double").alias("baseline"), (F.col("l_orderkey") * 100_000 + F.col("l_partkey")).alias("item_no"), F.col("p_name").alias("str"),
    )


def read_key_files(spark, sf_dir):
    """Keys written as text files, a folder for each paper, and read again."""
    folder = f"{scratch(spark)}/keys-{uuid.uuid4().hex}"
    format_keys(spark, sf_dir).repartition("paper_id").write.partitionBy("paper_id").text(folder)
    files = K.read_key_files(spark, folder)
    return K.key_rows(files.select(F.regexp_extract("path", "paper_id=([0-9]+)", 1).cast("long").alias("paper_id"), "text"))


def edited_questions(spark, sf_dir):
    """Questions with edited stems and options: a table of two rows, and options among blank lines."""
    q = T.questions(spark, sf_dir).select("qid", "stem", "options", "answer").withColumn("warnings", F.array(F.lit("old")))
    lines = F.concat(L.text_of_stem(F.col("stem")), F.lit("\n\u00a0\nA | "), F.get("options", F.lit(0)), F.lit("\nB | "), F.get("options", F.lit(1)), F.lit("\nlast"))
    few = F.slice("options", 1, (F.col("qid") % 4 + 1).cast("int"))
    edits = q.where("qid % 2 = 0").select("qid", lines.alias("stem_text"), F.concat(F.lit("\n "), F.array_join(few, " \u2003\n\n")).alias("options_text"))
    e = L.edit_questions(q, edits)
    return e.select("qid", L.text_of_stem(F.col("stem")).alias("lines"), F.size("stem").alias("blocks"), F.array_join("options", "|").alias("options"), "answer", F.array_join("warnings", "|").alias("warnings"))


def paper_settings(spark, sf_dir):
    """Minutes and marks of every paper, where some have minutes of their own."""
    p = L.keyed_counts(_questions(spark, sf_dir).withColumn("warnings", F.array())).select("paper_id", "questions", F.when(F.col("paper_id") % 4 == 0, F.lit(90)).cast("long").alias("minutes"))
    return L.with_settings(p)


def change_feed(spark, sf_dir):
    """Orders after a change feed in which some are changed twice, some removed, and some removed and put back."""
    o = T.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    one = o.where("id % 3 = 0").select("id", (F.col("value") + 1).alias("value"), F.lit(1).alias("version"), (F.col("id") % 2 == 0).alias("removed"))
    two = o.where("id % 5 = 0").select("id", (F.col("value") + 2).alias("value"), F.lit(2).alias("version"), F.when(F.col("id") % 7 == 0, True).alias("removed"))
    late_first = apply_feed(apply_feed(o, two, "id"), one, "id")  # the second batch comes first, and the older versions change nothing then
    return present(late_first).select("id", F.round("value", 2).alias("value"))


def stored_papers(spark, sf_dir):
    """The index of a library after a merge: a fifth of its papers keyed anew, some of them removed, and an older version of others."""
    q = _questions(spark, sf_dir)
    entry = q.select("paper_id").distinct().select("paper_id", F.concat(F.lit("Paper "), "paper_id").alias("title"), F.lit("").alias("note"), F.lit("printed").alias("key_source"), F.lit(1).alias("version"), F.lit(False).alias("removed"))
    store = R.Store(f"{scratch(spark)}/papers/{uuid.uuid4().hex}", "paper_id", R.PAPERS, 16)
    store.create(R.paper_records(q, entry))
    fifth = entry.where("paper_id % 5 = 0").withColumns({"key_source": F.lit("copied"), "version": F.lit(2), "removed": F.col("paper_id") % 10 == 5})
    store.merge(R.paper_records(q.withColumn("answer", (F.col("pos") % 4).cast("int")), fifth))
    store.merge(R.paper_records(q.where("false"), entry.where("paper_id % 3 = 0").withColumns({"version": F.lit(0), "title": F.lit("old")})))
    return R.paper_index(store.read(spark))


def key_text_lines(spark, sf_dir):
    """Items put together as text, as for a key that is printed in a paper."""
    return L.key_text_from_items(_items(spark, sf_dir)).select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))


QUERIES = {f.__name__: f for f in (format_keys, read_pair_keys, read_tabular_keys, read_sequence_keys, apply_key, unknown_key_numbers, copy_answers_overwrite, copy_answers_fill, toggle_answers, clear_paper_key, keyed_counts, range_selection, missing_numbers, source_papers, library_cards, cascade_delete, catalog_in_library, upsert_records, low_text_documents, scanned_flags, question_lines, key_text_lines, read_key_files, edited_questions, paper_settings, change_feed, stored_papers)}

_Q = with_tables("questions")
_KEY = _Q + ", k AS (SELECT paper_id, n AS num, CAST((paper_id + n * 7) % 5 AS INT) AS idx FROM (SELECT DISTINCT paper_id FROM questions), (SELECT CAST(unnest(range(1, 61, 3)) AS INT) AS n))"
_COPIED = _Q + ", c AS (SELECT p_partkey AS qid, CAST(p_partkey % 4 AS INT) AS idx FROM part WHERE p_partkey % 3 = 0)"
_ITEMS = """WITH i AS (SELECT l_suppkey AS doc_id, l_linenumber AS page, CAST(l_partkey % 560 AS DOUBLE) AS x, l_quantity * 2 AS w, CAST(40 + 18 * (l_orderkey % 40) AS DOUBLE) AS baseline,
  l_orderkey * 100000 + l_partkey AS item_no, p_name AS str FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem) JOIN part ON p_partkey = l_partkey)"""

SQL = {
    "format_keys": _Q + " SELECT paper_id, string_agg(num || '-' || (answer + 1), ', ' ORDER BY pos) AS text FROM questions WHERE answer IS NOT NULL GROUP BY paper_id",
    "read_pair_keys": _Q + " SELECT paper_id, num, CAST(answer AS INT) AS idx FROM questions WHERE answer IS NOT NULL",
    "read_tabular_keys": _Q + " SELECT paper_id, num, CAST(answer AS INT) AS idx FROM (SELECT *, count(*) OVER (PARTITION BY paper_id, pos // 10) AS n FROM questions WHERE answer IS NOT NULL) WHERE n > 1",
    "read_sequence_keys": _Q + " SELECT paper_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY num) AS INT) AS num, CAST(answer AS INT) AS idx FROM questions WHERE answer IS NOT NULL",
    "apply_key": _KEY + " SELECT q.paper_id, qid, q.num, coalesce(idx, answer) AS answer FROM questions q LEFT JOIN k ON k.paper_id = q.paper_id AND k.num = q.num",
    "unknown_key_numbers": _KEY + " SELECT paper_id, num FROM k EXCEPT SELECT paper_id, num FROM questions",
    "copy_answers_overwrite": _COPIED + " SELECT qid, coalesce(idx, answer) AS answer FROM questions LEFT JOIN c USING (qid)",
    "copy_answers_fill": _COPIED + " SELECT qid, coalesce(answer, idx) AS answer FROM questions LEFT JOIN c USING (qid)",
    "toggle_answers": _COPIED + """, o AS (SELECT qid, idx, CASE WHEN idx IS NULL THEN answer WHEN answer = idx THEN NULL ELSE idx END AS answer, (idx + qid % 2) % 4 AS again FROM questions LEFT JOIN c USING (qid))
  SELECT qid, CASE WHEN idx IS NULL OR qid % 9 <> 0 THEN answer WHEN answer = again THEN NULL ELSE again END AS answer FROM o""",
    "clear_paper_key": _Q + " SELECT qid, CASE WHEN paper_id % 2 <> 0 THEN answer END AS answer FROM questions WHERE NOT (paper_id % 2 = 0 AND num = 50)",
    "keyed_counts": _Q + " SELECT paper_id, count(*) AS questions, count(answer) AS keyed, count_if(answer IS NULL) AS no_key, count_if(length(text) > 60 OR answer IS NULL) AS flagged FROM questions GROUP BY paper_id",
    "range_selection": _Q + " SELECT paper_id, count(*) AS chosen, count_if(answer IS NULL) AS no_key FROM questions WHERE num >= 11 GROUP BY paper_id",
    "missing_numbers": _Q + """, f AS (SELECT * FROM questions WHERE qid % 3 <> 0), s AS (SELECT paper_id, unnest(range(min(num), max(num) + 1)) AS num FROM f GROUP BY paper_id)
  SELECT paper_id, CAST(num AS INT) AS num FROM s EXCEPT SELECT paper_id, num FROM f""",
    "source_papers": _Q + """, p AS (SELECT paper_id, count(CASE WHEN paper_id % 3 <> 0 THEN answer END) AS keyed FROM questions GROUP BY paper_id)
  SELECT a.paper_id, any_value(a.keyed) AS keyed, count(b.paper_id) AS others FROM p a LEFT JOIN p b ON b.paper_id <> a.paper_id AND b.keyed > 0 GROUP BY a.paper_id""",
    "library_cards": with_tables("questions", "attempts") + """, q AS (SELECT paper_id, count(*) AS questions, count(answer) AS keyed FROM questions GROUP BY paper_id),
  a AS (SELECT attempt_id % 50 AS paper_id, count_if(status = 'submitted') AS submitted, count_if(status = 'in-progress') AS in_progress, count_if(status = 'scheduled') AS scheduled FROM attempts GROUP BY 1)
  SELECT paper_id, questions, keyed, coalesce(submitted, 0) AS submitted, coalesce(in_progress, 0) AS in_progress, coalesce(scheduled, 0) AS scheduled,
  CAST(greatest(5, floor(questions * 0.8::DOUBLE + 0.5)) AS BIGINT) AS minutes FROM q LEFT JOIN a USING (paper_id)""",
    "cascade_delete": with_tables("questions", "attempts") + " SELECT attempt_id % 50 AS paper_id, count(*) AS attempts FROM attempts WHERE attempt_id % 50 NOT IN (SELECT paper_id FROM questions WHERE paper_id % 7 = 3) GROUP BY 1",
    "catalog_in_library": "SELECT c_custkey AS catalog_id, c_name, min(o_orderkey) AS paper FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2",
    "upsert_records": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0 THEN round(o_totalprice * 2, 2) ELSE o_totalprice END AS value, CAST(CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0 THEN 2 ELSE 1 END AS INT) AS version FROM orders",
    "low_text_documents": "SELECT doc_id, CAST(length(text) AS INT) AS chars FROM documents WHERE length(text) < 40 * (doc_id % 10 + 1)",
    "scanned_flags": "SELECT page_id, page_id % 11 = 0 OR coalesce(regexp_matches(url, '(?i)omnipage|abbyy|tesseract|finereader|scan|ocr'), false) OR coalesce(regexp_matches(html, '(?i)omnipage|abbyy|tesseract|finereader|scan|ocr'), false) AS scanned FROM pages",
    "read_key_files": _Q + " SELECT paper_id, num, CAST(answer AS INT) AS idx FROM questions WHERE answer IS NOT NULL",
    "edited_questions": _Q + """, e AS (SELECT qid, array_to_string(paragraphs, chr(10)) AS p, len(paragraphs) AS n, options, answer, qid % 2 = 0 AS edited, CASE WHEN qid % 2 = 0 THEN options[1:qid % 4 + 1] ELSE options END AS o FROM questions)
  SELECT qid, CASE WHEN edited THEN p || chr(10) || 'A | ' || options[1] || chr(10) || 'B | ' || options[2] || chr(10) || 'last' ELSE p END AS lines, CAST(CASE WHEN edited THEN n + 2 ELSE n END AS INT) AS blocks,
  array_to_string(o, '|') AS options, CASE WHEN answer < len(o) THEN answer END AS answer, CASE WHEN NOT edited THEN 'old' WHEN len(o) < 2 THEN 'Fewer than two options.' ELSE '' END AS warnings FROM e""",
    "paper_settings": _Q + """ SELECT paper_id, count(*) AS questions, CAST(CASE WHEN paper_id % 4 = 0 THEN 90 ELSE greatest(5, floor(count(*) * 0.8::DOUBLE + 0.5)) END AS BIGINT) AS minutes, 1.0::DOUBLE AS plus, 0.33::DOUBLE AS minus FROM questions GROUP BY paper_id""",
    "change_feed": """SELECT o_orderkey AS id, round(CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 2 WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS value FROM orders
  WHERE NOT CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 7 = 0 WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 = 0 ELSE false END""",
    "stored_papers": _Q + """ SELECT paper_id, 'Paper ' || paper_id AS title, '' AS note, CASE WHEN paper_id % 5 = 0 THEN 'copied' ELSE 'printed' END AS key_source, CAST(count(*) AS INT) AS questions,
  CAST(CASE WHEN paper_id % 5 = 0 THEN count(*) ELSE count(answer) END AS INT) AS keyed FROM questions WHERE paper_id % 10 <> 5 GROUP BY paper_id""",
    "question_lines": _Q + " SELECT qid, num || '. ' || text || chr(10) || '   (a) ' || options[1] || chr(10) || '   (b) ' || options[2] || chr(10) || '   (c) ' || options[3] || chr(10) || '   (d) ' || options[4] AS lines FROM questions",
    "key_text_lines": _ITEMS + """, l AS (SELECT doc_id, page, floor(baseline / 4 + 0.5) AS r, string_agg(str, ' ' ORDER BY x, item_no, str) AS line FROM i GROUP BY ALL),
  d AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY page, r) AS text FROM l GROUP BY doc_id) SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS INT) AS chars FROM d""",
}
