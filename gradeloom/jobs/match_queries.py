"""Registered queries on matching questions of two versions of a paper."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions.text import norm, words
from gradeloom.operators import matching as M
from gradeloom.sources import exam_tables as T
from gradeloom.sources.exam_tables import with_tables


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.questions(spark, sf_dir).select("paper_id", "qid", "pos", "num", "text", "options", "answer")


def _target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other version: new numbers, reworded beginnings, options turned by qid mod 4, no answers."""
    q = _source(spark, sf_dir)
    turned = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get("options", (i + F.col("qid").cast("int")) % 4))
    text = F.when(F.col("qid") % 3 == 0, F.concat(F.lit("Read this. "), "text")).when(F.col("qid") % 3 == 1, F.upper("text")).otherwise(F.col("text"))
    pos = (F.col("pos") * 7 + 3) % 50
    return q.select("paper_id", (F.col("qid") + 1_000_000_000).alias("qid"), pos.alias("pos"), (pos + 1).alias("num"), text.alias("text"), turned.alias("options"), F.lit(None).cast("int").alias("answer"))


def norm_words(spark, sf_dir):
    """Word counts of every question with its options."""
    both = F.concat_ws(" ", "text", F.array_join("options", " "))
    w = _source(spark, sf_dir).select("qid", F.explode(words(both)).alias("word"))
    return w.groupBy("qid", "word").agg(F.count(F.lit(1)).alias("n"))


def norm_texts(spark, sf_dir):
    """Normalised beginnings of the benchmark items and the questions."""
    return _source(spark, sf_dir).select("qid", norm(F.concat(F.col("text"), F.lit(" 12land3 I l"))).alias("norm"))


def _same():
    return F.col("t_paper") == F.col("s_paper")


def question_pairs(spark, sf_dir):
    """Pairs of questions between both versions of each paper that are alike enough to be candidates."""
    p = M.similar_pairs(M.prepare(_target(spark, sf_dir)), M.prepare(_source(spark, sf_dir).where("answer IS NOT NULL")), _same())
    return p.select("t", "s", F.round("score", 9).alias("score"))


def option_similarities(spark, sf_dir):
    """Likeness of every option to the turned option at its place."""
    t = _target(spark, sf_dir).select((F.col("qid") - 1_000_000_000).alias("qid"), F.col("options").alias("other"))
    z = _source(spark, sf_dir).join(t, "qid").select("qid", F.posexplode(F.arrays_zip("options", "other")).alias("i", "z"))
    return z.select("qid", "i", F.round(M.option_similarity(F.concat(F.lit("only 1 "), F.col("z.options")), F.concat(F.lit("Only 1, "), F.col("z.other"))), 9).alias("with_number"), F.round(M.option_similarity(F.col("z.options"), F.col("z.other")), 9).alias("plain"))


def _decided(spark, sf_dir) -> DataFrame:
    return M.transfer(_target(spark, sf_dir), _source(spark, sf_dir), _same())


def transferred_answers(spark, sf_dir):
    """Answers copied from each paper to its other version."""
    return _decided(spark, sf_dir).select("t", "s", F.round("score", 9).alias("score"), "matched", "answer")


def transfer_summary(spark, sf_dir):
    """Matched, copied, unsure and unmatched questions of each paper, asked of its other version and of one that nobody has."""
    papers = _target(spark, sf_dir).select(F.col("paper_id").alias("t_paper")).distinct()
    asked = papers.select("t_paper", F.explode(F.array("t_paper", -F.col("t_paper") - 1)).alias("s_paper"))
    rows = M.summary(_decided(spark, sf_dir), _target(spark, sf_dir), asked)
    return rows.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("unsure", "unmatched")})


def _versions(spark, sf_dir) -> DataFrame:
    """The other versions as papers of their own, each with answers to a tenth of its questions."""
    answers = _source(spark, sf_dir).where("qid % 10 = 0").select((F.col("qid") + 1_000_000_000).alias("qid"), F.pmod(F.col("answer") - F.col("qid") % 4, F.lit(4)).cast("int").alias("answer"))
    other = _target(spark, sf_dir).drop("answer").join(answers, "qid", "left")
    return other.select((F.col("paper_id") + 1_000_000).alias("paper_id"), "qid", "pos", "num", "text", "options", "answer")


def best_sources(spark, sf_dir):
    """The best key source of every other version among all papers, versions with some answers included."""
    versions = _versions(spark, sf_dir)
    return M.best_sources(versions, _source(spark, sf_dir).unionByName(versions))


QUERIES = {f.__name__: f for f in (norm_words, norm_texts, question_pairs, option_similarities, transferred_answers, transfer_summary, best_sources)}


def _norm(s: str) -> str:
    s = f"regexp_replace(lower({s}), '[^a-z0-9]+', ' ', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '([a-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g')"
    s = f"regexp_replace(regexp_replace({s}, '\\bland\\b', '1 and', 'g'), '\\b[il]\\b', '1', 'g')"
    return f"trim(regexp_replace({s}, ' +', ' ', 'g'))"


def _words(s: str) -> str:
    return f"list_filter(string_split({_norm(s)}, ' '), lambda w: length(w) > 1 OR regexp_matches(w, '[0-9]'))"


_BOTH = with_tables("questions") + """, target AS (SELECT paper_id, qid + 1000000000 AS qid,
  (pos * 7 + 3) % 50 AS pos, CASE qid % 3 WHEN 0 THEN 'Read this. ' || text WHEN 1 THEN upper(text) ELSE text END AS text,
  [options[1 + qid % 4], options[1 + (qid + 1) % 4], options[1 + (qid + 2) % 4], options[1 + (qid + 3) % 4]] AS options FROM questions)"""


#: Versions as papers of their own, and a library of all papers.
_LIBRARY = with_tables("questions") + """, target AS (SELECT paper_id + 1000000 AS paper_id, qid + 1000000000 AS qid,
  (pos * 7 + 3) % 50 AS pos, CASE qid % 3 WHEN 0 THEN 'Read this. ' || text WHEN 1 THEN upper(text) ELSE text END AS text,
  [options[1 + qid % 4], options[1 + (qid + 1) % 4], options[1 + (qid + 2) % 4], options[1 + (qid + 3) % 4]] AS options,
  CASE WHEN qid % 10 = 0 THEN (answer - qid % 4 + 4) % 4 END AS answer FROM questions),
  library AS (SELECT paper_id, qid, pos, text, options, answer FROM questions UNION ALL SELECT paper_id, qid, pos, text, options, answer FROM target)"""


def _dice(paired: str, tables: str = _BOTH, source: str = "questions") -> str:
    return f"""{tables}, q AS (SELECT 't' AS side, paper_id, qid, text, array_to_string(options, ' ') AS o FROM target UNION ALL SELECT 's', paper_id, qid, text, array_to_string(options, ' ') FROM {source} WHERE answer IS NOT NULL),
  tok AS (SELECT side, paper_id, qid, kind, w, count(*) AS n FROM (
    SELECT side, paper_id, qid, 'stem' AS kind, unnest({_words("text")}) AS w FROM q UNION ALL SELECT side, paper_id, qid, 'all', unnest({_words("text || ' ' || o")}) FROM q) GROUP BY ALL),
  size AS (SELECT side, qid, kind, sum(n) AS n FROM tok GROUP BY ALL),
  com AS (SELECT a.qid AS t, b.qid AS s, a.kind, sum(least(a.n, b.n)) AS c FROM tok a JOIN tok b ON a.side = 't' AND b.side = 's' AND {paired} AND a.kind = b.kind AND a.w = b.w GROUP BY ALL),
  d AS (SELECT t, s, com.kind, 2.0::DOUBLE * c / (x.n + y.n) AS dice FROM com JOIN size x ON x.side = 't' AND x.qid = t AND x.kind = com.kind JOIN size y ON y.side = 's' AND y.qid = s AND y.kind = com.kind),
  sc AS (SELECT t, s, 0.7::DOUBLE * coalesce(max(dice) FILTER (kind = 'stem'), 0) + 0.3::DOUBLE * coalesce(max(dice) FILTER (kind = 'all'), 0) AS score FROM d GROUP BY t, s)"""


def _option(a: str, b: str) -> str:
    q = "^(only|both|neither|nor|all|none|and|or)$"
    wx, wy = (f"list_filter(string_split({v}, ' '), lambda w: length(w) > 1 OR regexp_matches(w, '[0-9]'))" for v in "xy")
    return f"""(SELECT CASE WHEN x = '' OR y = '' THEN 0.0::DOUBLE WHEN x = y THEN 1.0 WHEN length(dx) >= 3 AND length(dy) >= 3 AND regexp_matches(x, '[a-d]\\s*[0-9]') AND regexp_matches(y, '[a-d]\\s*[0-9]') THEN CASE WHEN dx = dy THEN 0.95 ELSE 0 END
      WHEN dx <> '' AND dy <> '' AND length(x) < 40 AND length(y) < 40 THEN CASE WHEN dx = dy AND list_filter(string_split(x, ' '), lambda w: regexp_matches(w, '{q}')) = list_filter(string_split(y, ' '), lambda w: regexp_matches(w, '{q}')) THEN 0.95 ELSE 0.2 END
      ELSE least(0.9, CASE WHEN len({wx}) + len({wy}) > 0 THEN 2.0::DOUBLE * len(list_intersect({wx}, {wy})) / (len({wx}) + len({wy})) ELSE 0 END) END
      FROM (SELECT *, regexp_replace(x, '[^0-9]', '', 'g') AS dx, regexp_replace(y, '[^0-9]', '', 'g') AS dy FROM (SELECT {_norm(a)} AS x, {_norm(b)} AS y)))"""


def _decided_sql(paired: str, tables: str = _BOTH, source: str = "questions") -> str:
    """Greedy choice in each pair of papers as a fold over its sorted pairs, then the options of each chosen pair."""
    opt = _option("want", "o")
    return f"""{_dice(paired, tables, source)}, p AS (SELECT sc.*, t.paper_id AS t_paper, s.paper_id AS s_paper, t.pos AS t_pos, s.pos AS s_pos FROM sc JOIN target t ON t.qid = sc.t JOIN {source} s ON s.qid = sc.s WHERE score >= 0.55::DOUBLE * 0.8::DOUBLE),
  g AS (SELECT t_paper, s_paper, list_reduce(list([{{'t': t, 's': s, 'score': score}}] ORDER BY score DESC, t_pos, s_pos),
    lambda a, x: CASE WHEN list_contains(list_transform(a, lambda y: y.t), x[1].t) OR list_contains(list_transform(a, lambda y: y.s), x[1].s) THEN a ELSE list_concat(a, x) END) AS chosen FROM p GROUP BY ALL),
  c AS (SELECT t_paper, s_paper, u.t, u.s, u.score, u.score >= 0.55::DOUBLE AS matched FROM (SELECT t_paper, s_paper, unnest(chosen) AS u FROM g)),
  o AS (SELECT c.*, len(t.options) = len(s.options) AS as_many, coalesce(s.options[s.answer + 1], '') AS want, unnest(range(len(t.options))) AS i, unnest(t.options) AS o FROM c JOIN target t ON t.qid = c.t JOIN {source} s ON s.qid = c.s),
  v AS (SELECT *, length({_norm("o")}) < 3 AS blank, {opt} AS sim FROM o),
  r AS (SELECT *, row_number() OVER w AS place, lead(sim) OVER w AS runner FROM v WINDOW w AS (PARTITION BY t, s ORDER BY sim DESC, i)),
  b AS (SELECT t, s, t_paper, s_paper, any_value(score) AS score, any_value(matched) AS matched, any_value(as_many) AS as_many, max(sim) FILTER (place = 1) AS best, max(runner) FILTER (place = 1) AS runner, max(i) FILTER (place = 1) AS best_i,
    count_if(blank) AS blanks, min(i) FILTER (blank) AS blank_i, bool_and(blank OR sim < 0.5::DOUBLE) AS others FROM r GROUP BY ALL),
  made AS (SELECT *, CAST(CASE WHEN NOT matched THEN NULL WHEN best >= 0.6::DOUBLE AND (runner IS NULL OR best - runner >= 0.1::DOUBLE OR (best = 1 AND runner < 1)) THEN best_i WHEN as_many AND blanks = 1 AND others THEN blank_i END AS INT) AS answer FROM b)"""


_SAME = "a.paper_id = b.paper_id"

SQL = {
    "norm_words": with_tables("questions") + f" SELECT qid, w AS word, count(*) AS n FROM (SELECT qid, unnest({_words("text || ' ' || array_to_string(options, ' ')")}) AS w FROM questions) GROUP BY ALL",
    "norm_texts": with_tables("questions") + f" SELECT qid, {_norm("text || ' 12land3 I l'")} AS norm FROM questions",
    "transferred_answers": _decided_sql(_SAME) + " SELECT t, s, round(score, 9) AS score, matched, answer FROM made",
    "transfer_summary": _decided_sql(_SAME) + """, a AS (SELECT paper_id AS t_paper, unnest([paper_id, -paper_id - 1]) AS s_paper FROM (SELECT DISTINCT paper_id FROM target)),
  n AS (SELECT made.*, t.pos + 1 AS num FROM made JOIN target t ON t.qid = made.t),
  e AS (SELECT t_paper, s_paper, count_if(matched) AS matched, count(answer) AS copied, string_agg(CASE WHEN answer IS NULL THEN num END, ',' ORDER BY num) AS unsure FROM n GROUP BY ALL),
  l AS (SELECT a.t_paper, a.s_paper, string_agg(t.pos + 1, ',' ORDER BY t.pos) AS unmatched FROM a JOIN target t ON t.paper_id = a.t_paper AND NOT EXISTS (SELECT 1 FROM n WHERE n.t = t.qid AND n.s_paper = a.s_paper) GROUP BY ALL)
  SELECT t_paper, s_paper, coalesce(matched, 0) AS matched, coalesce(copied, 0) AS copied, coalesce(unsure, '') AS unsure, coalesce(unmatched, '') AS unmatched FROM a LEFT JOIN e USING (t_paper, s_paper) LEFT JOIN l USING (t_paper, s_paper)""",
    "best_sources": _decided_sql("a.paper_id <> b.paper_id", _LIBRARY, "library") + """, n AS (SELECT t_paper, s_paper, count(answer) AS copied FROM made GROUP BY ALL), z AS (SELECT paper_id AS t_paper, count(*) AS questions FROM target GROUP BY 1)
  SELECT t_paper, s_paper, copied, questions FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY t_paper ORDER BY copied DESC, s_paper) = 1) JOIN z USING (t_paper) WHERE copied >= 0.3::DOUBLE * questions""",
    "question_pairs": _dice(_SAME) + " SELECT t, s, round(score, 9) AS score FROM sc WHERE score >= 0.55::DOUBLE * 0.8::DOUBLE",
    "option_similarities": _BOTH + f""", z AS (SELECT q.qid, CAST(unnest([0, 1, 2, 3]) AS INT) AS i, unnest(q.options) AS a, unnest(t.options) AS b FROM questions q JOIN target t ON t.qid = q.qid + 1000000000)
      SELECT qid, i, round({_option("'only 1 ' || a", "'Only 1, ' || b")}, 9) AS with_number, round({_option("a", "b")}, 9) AS plain FROM z""",
}
