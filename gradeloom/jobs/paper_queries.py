"""Registered queries on positioned text, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.functions.text import ENGLISH_WORDS, devanagari_share, english_score, squeeze
from gradeloom.operators import extraction as X
from gradeloom.operators import layout as L
from gradeloom.operators.keys import apply_printed_key
from gradeloom.operators.library import low_text
from gradeloom.operators.nearest import nearest_left
from gradeloom.sources import exam_tables as T
from gradeloom.sources.exam_tables import with_tables

#: Questions of a printed page, and its size.
ON_PAGE, WIDTH, HEIGHT = 6, 612.0, 792.0


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paper of questions as positioned text: numbered stems, four options, the answer where there is one."""
    q = T.questions(spark, sf_dir)
    top = 100 + F.col("pos") / F.lit(50.0) * 40 + (F.col("pos") % ON_PAGE) * 98
    label = lambda i: F.substring(F.lit("abcd"), i + 1, F.lit(1))
    options = F.transform("options", lambda o, i: F.struct(F.lit(82.0).alias("x"), (i + 1).alias("row"), F.concat(F.lit("("), label(i), F.lit(") "), o).alias("str")))
    stem = F.array(F.struct(F.lit(60.0).alias("x"), F.lit(0).alias("row"), F.concat((F.col("pos") + 1).cast("string"), F.lit(". "), "text").alias("str")))
    answer = F.when(F.col("answer").isNull(), F.expr("cast(array() as array<struct<x:double,row:int,str:string>>)")).otherwise(F.array(F.struct(F.lit(77.0).alias("x"), F.lit(5).alias("row"), F.concat(F.lit("Answer: ("), label(F.col("answer")), F.lit(")")).alias("str"))))
    rows = q.select(F.col("paper_id").alias("doc_id"), "pos", top.alias("top"), F.explode(F.concat(stem, options, answer)).alias("i"))
    return rows.select(
        "doc_id", (F.floor(F.col("pos") / ON_PAGE) + 1).cast("int").alias("page"), F.lit(WIDTH).alias("page_width"), F.lit(HEIGHT).alias("page_height"), (F.col("pos") * 10 + F.col("i.row")).cast("int").alias("item_no"),
        "i.str", "i.x", (F.length("i.str") * 5.0).alias("w"), (F.col("top") + F.col("i.row") * 16).alias("baseline"), F.lit(11.0).alias("size"),
    )


def extracted_questions(spark, sf_dir):
    """Questions read back from their printed pages."""
    asked, _ = X.extract(printed(spark, sf_dir))
    return asked.select(F.col("doc_id").alias("paper_id"), "num", F.get("stem", F.lit(0))["text"].alias("text"), F.array_join("options", "|").alias("options"), "answer")


def extracted_stats(spark, sf_dir):
    """Counts of every printed paper."""
    items = printed(spark, sf_dir)
    asked, _ = X.extract(items)
    s = X.paper_stats(asked, items)
    return s.select(F.col("doc_id").alias("paper_id"), "pages", "found", F.size("missing").alias("missing"), "with_warnings", "low_quality")


def _items(spark, sf_dir) -> DataFrame:
    """Positioned items from lineitem and part; a document for each supplier."""
    i = T.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").distinct()
    p = T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return i.join(p, "l_partkey").select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.lit(WIDTH).alias("page_width"), F.lit(HEIGHT).alias("page_height"), (F.col("l_partkey") % 56 * 10).cast("double").alias("x"),
        (F.col("l_quantity") * 2).alias("w"), (40 + 18 * (F.col("l_orderkey") % 40)).cast("double").alias("baseline"), (F.col("l_orderkey") * 100_000 + F.col("l_partkey")).alias("item_no"), F.col("p_name").alias("str"), F.lit(11.0).alias("size"),
    )


def printed_keys(spark, sf_dir):
    """Papers that print a key of other answers on their last page: it overrules the answers beside the questions."""
    q = T.questions(spark, sf_dir).where("answer IS NOT NULL")
    pair = F.concat((F.col("pos") + 1).cast("string"), F.lit("-"), F.substring(F.lit("abcd"), ((F.col("answer") + 1) % 4 + 1).cast("int"), F.lit(1)))
    lines = q.groupBy(F.col("paper_id").alias("doc_id"), (F.floor(F.col("pos") / 10) + 1).cast("int").alias("row")).agg(F.array_sort(F.collect_list(F.struct("pos", pair.alias("s")))).alias("e"))
    lines = lines.select("doc_id", "row", F.array_join(F.col("e.s"), ", ").alias("str")).unionByName(q.select(F.col("paper_id").alias("doc_id"), F.lit(0).alias("row"), F.lit("Answer Key").alias("str")).distinct())
    key = lines.select(
        "doc_id", F.lit(50 // ON_PAGE + 2).alias("page"), F.lit(WIDTH).alias("page_width"), F.lit(HEIGHT).alias("page_height"), "row", F.col("row").alias("item_no"), "str",
        F.lit(60.0).alias("x"), (F.length("str") * 5.0).alias("w"), (F.col("row") * 20.0 + 120).alias("baseline"), F.lit(11.0).alias("size"),
    ).drop("row")
    asked, keys = X.extract(printed(spark, sf_dir).unionByName(key))
    made = apply_printed_key(asked, keys.withColumnRenamed("key_text", "text"))
    return made.select(F.col("doc_id").alias("paper_id"), "num", "answer")


def question_regions(spark, sf_dir):
    """The box of every question on its printed page."""
    asked, _ = X.extract(printed(spark, sf_dir), boxes=True)
    rows = asked.select(F.col("doc_id").alias("paper_id"), "num", F.explode("regions").alias("r"))
    return rows.select("paper_id", "num", "r.page", *(F.round(F.col(f"r.{c}"), 6).alias(c) for c in ("x0", "x1", "y0", "y1")))


def english_scores(spark, sf_dir):
    """English score and Devanagari share of every document."""
    d = T.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.round(english_score(F.col("text")), 9).alias("score"), devanagari_share(F.col("text")).alias("share"))


def squeezed_titles(spark, sf_dir):
    """Letter-spaced and bracketed spellings of part names closed up."""
    p = T.read(spark, sf_dir, "part")
    spaced = F.array_join(F.split(F.replace("p_name", F.lit(" "), F.lit("")), ""), " ")
    return p.select("p_partkey", squeeze(F.trim(spaced)).alias("closed"), squeeze(F.concat(F.lit("(\u00a0a ) \u3000"), "p_name")).alias("label"))


def _columns(items: DataFrame) -> DataFrame:
    """Every other paper with its questions in two columns, narrower than the printed ones."""
    two, right = F.col("doc_id") % 2 == 0, F.floor(F.col("item_no") / 10) % 2 == 1
    return items.withColumns({"x": F.when(two, F.col("x") * 0.5 + F.when(right, 300.0).otherwise(0.0)).otherwise(F.col("x")), "w": F.when(two, F.least(F.col("w") * 0.5, F.lit(250.0))).otherwise(F.col("w"))})


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed papers in other editions: even ones in two columns, all with page numbers, every third with a page in Hindi after each second page."""
    items, place = printed(spark, sf_dir), F.floor(F.col("item_no") / 10) % ON_PAGE
    two, right = F.col("doc_id") % 2 == 0, place >= ON_PAGE / 2
    items = items.withColumns({
        "baseline": F.when(two & right, F.col("baseline") - ON_PAGE / 2 * 98).otherwise(F.col("baseline")), "w": F.when(two, F.least(F.col("w") * 0.5, F.lit(250.0))).otherwise(F.col("w")),
        "x": F.when(two, F.col("x") * 0.5 + F.when(right, 300.0).otherwise(0.0)).otherwise(F.col("x")), "page": F.when(F.col("doc_id") % 3 == 0, F.col("page") + F.floor((F.col("page") - 1) / 2).cast("int")).otherwise(F.col("page")),
    })
    sheets = items.select("doc_id", "page", "page_width", "page_height").distinct()
    foot = sheets.select("*", F.lit(9001).alias("item_no"), F.concat(F.lit("Page "), "page").alias("str"), F.lit(290.0).alias("x"), F.lit(30.0).alias("w"), F.lit(780.0).alias("baseline"), F.lit(11.0).alias("size"))
    hindi = sheets.where("doc_id % 3 = 0 AND page % 3 = 2").withColumn("page", F.col("page") + 1).select("*", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("item_no"))
    hindi = hindi.select("*", F.concat(F.col("item_no").cast("string"), F.lit(". भारत की राजधानी क्या है और कौन सा कथन सही है "), F.col("page").cast("string")).alias("str"), F.lit(60.0).alias("x"), F.lit(280.0).alias("w"), (F.col("item_no") * 40.0 + 100).alias("baseline"), F.lit(11.0).alias("size"))
    return items.unionByName(foot).unionByName(hindi)


def extracted_editions(spark, sf_dir):
    """Questions read back from the other editions."""
    asked, _ = X.extract(editions(spark, sf_dir))
    return asked.select(F.col("doc_id").alias("paper_id"), "num", "qid", F.get("stem", F.lit(0))["text"].alias("text"), F.array_join("options", "|").alias("options"), "answer")


def edition_stats(spark, sf_dir):
    """Counts of the other editions, with the pages that Hindi stands on."""
    items = editions(spark, sf_dir)
    asked, _ = X.extract(items)
    s = X.paper_stats(asked, items)
    return s.select(F.col("doc_id").alias("paper_id"), "pages", "found", F.size("missing").alias("missing"), "skipped", "with_warnings", "low_quality")


def page_gutters(spark, sf_dir):
    """The gutter of every page that has one."""
    return L.gutters(_columns(printed(spark, sf_dir)))


def nearest_markers(spark, sf_dir):
    """For the even lines of every order the odd line at or left of their price, by eight and more: continuations and their options."""
    i = T.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("x"))
    runs, marks = i.where("line % 2 = 0"), i.where("line % 2 = 1")
    return nearest_left(runs, marks, ["question"], F.col("x") + 8, F.col("x"), F.col("line"))


def kept_items(spark, sf_dir):
    """Items of every page that no repeated header or footer is."""
    items = _items(spark, sf_dir)
    return L.drop_repeated(items, items.select("doc_id", "page")).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("items"), F.sum("item_no").alias("checksum"))


def order_statistics(spark, sf_dir):
    """Upper median and 30th percentile of item positions on every page."""
    g = _items(spark, sf_dir).groupBy("doc_id", "page").agg(F.collect_list("x").alias("v"))
    return g.select("doc_id", "page", L.upper_median(F.col("v")).alias("median"), F.when(F.size("v") >= 3, L.upper_median(F.col("v"), 0.3)).alias("p30"))


def line_gaps(spark, sf_dir):
    """Dense page numbers and the steps from line to line that are no overlap."""
    b = _items(spark, sf_dir).select("doc_id", "page", "baseline", "size").distinct()
    gap = F.col("baseline") - F.lag("baseline").over(Window.partitionBy("doc_id", "page").orderBy("baseline"))
    b = b.withColumns({"gap": gap, "page_no": F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page"))})
    return b.where(F.col("gap") > F.col("size") * 0.8).groupBy("doc_id", "page", "page_no").agg(F.count(F.lit(1)).alias("gaps"), F.sum("gap").alias("total"))


def page_boxes(spark, sf_dir):
    """Box around the items of every page, four points wider, inside the page."""
    g = _items(spark, sf_dir).groupBy("doc_id", "page", "page_width", "page_height").agg(F.min("x").alias("a"), F.max(F.col("x") + F.col("w")).alias("b"), F.min(F.col("baseline") - F.col("size")).alias("c"), F.max(F.col("baseline")).alias("d"))
    zero = F.lit(0.0)
    return g.select("doc_id", "page", F.greatest(zero, F.col("a") - 4).alias("x0"), F.least("page_width", F.col("b") + 4).alias("x1"), F.greatest(zero, F.col("c") - 4).alias("y0"), F.least("page_height", F.col("d") + 4).alias("y1"))


def low_text_papers(spark, sf_dir):
    """Papers with fewer than 40 characters for each page."""
    g = _items(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.length("str")).alias("chars"), F.count_distinct("page").alias("pages"))
    return g.select("doc_id", "chars", "pages", low_text(F.col("chars"), F.col("pages")).alias("rejected"))


def upright_items(spark, sf_dir):
    """Items from text with a transform: turned and blank text dropped, missing widths estimated."""
    i = T.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag").distinct()
    size = F.col("l_quantity") / 2
    m = F.array(size, F.when(F.col("l_returnflag") == "R", F.lit(0.5)).otherwise(F.lit(0.0)), F.lit(0.0), F.when(F.col("l_linenumber") == 1, F.lit(0.0)).otherwise(size), (F.col("l_partkey") % 560).cast("double"), (F.col("l_orderkey") % 700).cast("double"))
    raw = i.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", m.alias("transform"), F.when(F.col("l_discount") > 0.05, F.lit(33.0)).alias("width"), F.lit(792.0).alias("page_height"), F.when(F.col("l_partkey") % 10 == 0, "\u00a0\u2003").otherwise(F.col("l_returnflag")).alias("str"))
    g = L.from_transform(raw)
    return g.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("w"), 6).alias("w"), F.round(F.sum("baseline"), 6).alias("baseline"), F.round(F.sum("size"), 6).alias("size"), F.round(F.sum("x"), 6).alias("x"))


QUERIES = {f.__name__: f for f in (extracted_questions, extracted_stats, printed_keys, question_regions, english_scores, squeezed_titles, kept_items, order_statistics, line_gaps, page_boxes, low_text_papers, upright_items, page_gutters, nearest_markers, extracted_editions, edition_stats)}

_I = """WITH i AS (SELECT l_suppkey AS doc_id, l_linenumber AS page, CAST(l_partkey % 56 * 10 AS DOUBLE) AS x, l_quantity * 2 AS w, CAST(40 + 18 * (l_orderkey % 40) AS DOUBLE) AS baseline,
  l_orderkey * 100000 + l_partkey AS item_no, p_name AS str FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem) JOIN part ON p_partkey = l_partkey)"""
_STOP = ", ".join(f"'{w}'" for w in sorted(set(ENGLISH_WORDS)))

SQL = {
    "extracted_questions": with_tables("questions") + " SELECT paper_id, CAST(pos + 1 AS INT) AS num, text, array_to_string(options, '|') AS options, CAST(answer AS INT) AS answer FROM questions",
    "extracted_stats": with_tables("questions") + " SELECT paper_id, count(DISTINCT pos // 6) AS pages, count(*) AS found, 0 AS missing, 0::BIGINT AS with_warnings, false AS low_quality FROM questions GROUP BY paper_id",
    "extracted_editions": with_tables("questions") + " SELECT paper_id, CAST(pos + 1 AS INT) AS num, 'q' || (pos + 1) || '-' || (row_number() OVER (PARTITION BY paper_id ORDER BY pos) - 1) AS qid, text, array_to_string(options, '|') AS options, CAST(answer AS INT) AS answer FROM questions",
    "edition_stats": with_tables("questions") + """, s AS (SELECT DISTINCT paper_id, CASE WHEN paper_id % 3 = 0 THEN pos // 6 + 1 + (pos // 6) // 2 ELSE pos // 6 + 1 END AS page FROM questions),
  h AS (SELECT paper_id, count(*) AS n FROM s WHERE paper_id % 3 = 0 AND page % 3 = 2 GROUP BY 1), p AS (SELECT paper_id, count(*) AS n FROM s GROUP BY 1)
  SELECT q.paper_id, any_value(p.n) + coalesce(any_value(h.n), 0) AS pages, count(*) AS found, 0 AS missing, coalesce(any_value(h.n), 0) AS skipped, 0::BIGINT AS with_warnings, false AS low_quality FROM questions q JOIN p USING (paper_id) LEFT JOIN h USING (paper_id) GROUP BY q.paper_id""",
    "printed_keys": with_tables("questions") + " SELECT paper_id, CAST(pos + 1 AS INT) AS num, CAST((answer + 1) % 4 AS INT) AS answer FROM questions",
    "question_regions": with_tables("questions") + """, q AS (SELECT paper_id, pos, 100 + pos / 50.0::DOUBLE * 40 + pos % 6 * 98 AS t, pos + 1 || '. ' || text AS s, options, answer FROM questions),
  l AS (SELECT paper_id, pos, 60 + 5.0::DOUBLE * length(s) AS x2, true AS shown FROM q UNION ALL SELECT paper_id, pos, 82 + 5.0::DOUBLE * (4 + length(unnest(options))), true FROM q
    UNION ALL SELECT paper_id, pos, 77 + 5.0::DOUBLE * length('Answer: (a)'), false FROM q WHERE answer IS NOT NULL),
  g AS (SELECT paper_id, pos // 6 AS page, max(x2) AS r FROM l GROUP BY ALL), m AS (SELECT paper_id, list_sort(list(r))[len(list(r)) // 2 + 1] AS col_right FROM g GROUP BY paper_id), b AS (SELECT paper_id, pos, max(x2) AS x2 FROM l WHERE shown GROUP BY ALL)
  SELECT paper_id, CAST(pos + 1 AS INT) AS num, CAST(pos // 6 + 1 AS INT) AS page, 56.0::DOUBLE AS x0, round(least(612, greatest(col_right, b.x2) + 4), 6) AS x1, round(t - 15, 6) AS y0, round(t + 64 + 0.3::DOUBLE * 11 + 4, 6) AS y1
  FROM q JOIN b USING (paper_id, pos) JOIN m USING (paper_id)""",
    "nearest_markers": """WITH i AS (SELECT l_orderkey AS question, l_linenumber AS line, l_extendedprice AS x FROM lineitem)
  SELECT l.question, l.line, l.x, arg_max(r.line, (r.x, r.line)) AS nearest FROM i l LEFT JOIN i r ON r.question = l.question AND r.line % 2 = 1 AND r.x <= l.x + 8 WHERE l.line % 2 = 0 GROUP BY ALL""",
    "page_gutters": with_tables("questions") + """, s AS (SELECT paper_id, pos, 60.0::DOUBLE AS x, pos + 1 || '. ' || text AS s FROM questions UNION ALL SELECT paper_id, pos, 82, '(a) ' || unnest(options) FROM questions
    UNION ALL SELECT paper_id, pos, 77, 'Answer: (a)' FROM questions WHERE answer IS NOT NULL),
  i AS (SELECT paper_id AS doc_id, CAST(pos // 6 + 1 AS INT) AS page, CASE WHEN paper_id % 2 = 0 THEN x * 0.5::DOUBLE + CASE WHEN pos % 2 = 1 THEN 300 ELSE 0 END ELSE x END AS x, CASE WHEN paper_id % 2 = 0 THEN least(length(s) * 2.5::DOUBLE, 250) ELSE length(s) * 5.0::DOUBLE END AS w FROM s),
  n AS (SELECT doc_id, page, count(*) AS n, sum(w) AS all_w FROM i GROUP BY ALL),
  c AS (SELECT doc_id, page, p, count_if(floor(x) <= p AND p < ceil(x + w)) AS cover FROM i, (SELECT unnest(range(171, 442)) AS p) GROUP BY ALL),
  f AS (SELECT doc_id, page, p, p - row_number() OVER (PARTITION BY doc_id, page ORDER BY p) AS island FROM c JOIN n USING (doc_id, page) WHERE n >= 12 AND cover <= n // 100),
  g AS (SELECT doc_id, page, min(p) AS a, max(p) + 1 AS b, (min(p) + max(p) + 1) / 2.0::DOUBLE AS middle FROM f GROUP BY doc_id, page, island HAVING max(p) + 1 - min(p) >= 4),
  t AS (SELECT g.doc_id, g.page, a, b, middle, all_w, sum(w) FILTER (x < middle) AS left_w FROM g JOIN n USING (doc_id, page) JOIN i USING (doc_id, page) GROUP BY ALL)
  SELECT doc_id, page, middle FROM t WHERE least(left_w, all_w - left_w) >= 0.15::DOUBLE * all_w QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY b - a - abs(middle - 306) * 0.25::DOUBLE DESC, a) = 1""",
    "english_scores": f"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]{{2,}}') AS w, len(regexp_extract_all(text, '[A-Za-zऀ-ॿ]')) AS letters, len(regexp_extract_all(text, '[ऀ-ॿ]')) AS dev, len(regexp_extract_all(text, '\\S')) AS seen FROM documents)
  SELECT doc_id, round(CASE WHEN letters = 0 THEN NULL WHEN dev::DOUBLE / letters > 0.3 THEN 0.0 WHEN len(w) > 0 THEN len(list_filter(w, lambda x: lower(x) IN ({_STOP})))::DOUBLE / len(w) END, 9) AS score, CASE WHEN seen > 0 THEN dev::DOUBLE / seen ELSE 0.0 END AS share FROM d""",
    "squeezed_titles": "SELECT p_partkey, replace(p_name, ' ', '') AS closed, '(a) ' || p_name AS label FROM part",
    "kept_items": _I + """, k AS (SELECT *, floor(x / 3 + 0.5) AS kx, floor(baseline / 3 + 0.5) AS ky FROM i), o AS (SELECT doc_id, str, kx, ky, count(DISTINCT page) AS n FROM k GROUP BY ALL), p AS (SELECT doc_id, count(DISTINCT page) AS pages FROM i GROUP BY doc_id)
  SELECT doc_id, page, count(*) AS items, sum(item_no)::BIGINT AS checksum FROM k JOIN o USING (doc_id, str, kx, ky) JOIN p USING (doc_id)
  WHERE NOT (pages >= 3 AND n >= greatest(3, ceil(pages * 0.4::DOUBLE)) AND (baseline < 792 * 0.09 OR baseline > 792 * 0.9 OR length(str) >= 12)) GROUP BY ALL""",
    "order_statistics": _I + ", g AS (SELECT doc_id, page, list_sort(list(x)) AS v FROM i GROUP BY ALL) SELECT doc_id, page, v[CAST(floor(len(v) * 0.5) AS INT) + 1] AS median, CASE WHEN len(v) >= 3 THEN v[CAST(floor(len(v) * 0.3::DOUBLE) AS INT) + 1] END AS p30 FROM g",
    "line_gaps": _I + """, b AS (SELECT DISTINCT doc_id, page, baseline FROM i), g AS (SELECT *, baseline - lag(baseline) OVER (PARTITION BY doc_id, page ORDER BY baseline) AS gap, dense_rank() OVER (PARTITION BY doc_id ORDER BY page) AS page_no FROM b)
  SELECT doc_id, page, CAST(page_no AS INT) AS page_no, count(*) AS gaps, sum(gap) AS total FROM g WHERE gap > 8.8 GROUP BY ALL""",
    "page_boxes": _I + " SELECT doc_id, page, greatest(0.0::DOUBLE, min(x) - 4) AS x0, least(612.0::DOUBLE, max(x + w) + 4) AS x1, greatest(0.0::DOUBLE, min(baseline - 11) - 4) AS y0, least(792.0::DOUBLE, max(baseline) + 4) AS y1 FROM i GROUP BY doc_id, page",
    "low_text_papers": _I + " SELECT doc_id, sum(length(str))::BIGINT AS chars, count(DISTINCT page) AS pages, sum(length(str)) < 40 * count(DISTINCT page) AS rejected FROM i GROUP BY doc_id",
    "upright_items": """WITH i AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_returnflag FROM lineitem),
  k AS (SELECT *, l_quantity / 2 AS size FROM i WHERE l_partkey % 10 <> 0 AND l_returnflag <> 'R' AND l_quantity > 0)
  SELECT l_suppkey, count(*) AS items, round(sum(CASE WHEN l_discount > 0.05 THEN 33.0::DOUBLE ELSE size * 0.5 END), 6) AS w, round(sum(792.0::DOUBLE - l_orderkey % 700), 6) AS baseline, round(sum(size), 6) AS size, round(sum(CAST(l_partkey % 560 AS DOUBLE)), 6) AS x FROM k GROUP BY l_suppkey""",
}
