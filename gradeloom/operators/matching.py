"""Copying answer keys between versions of a paper by the wording of questions and options.

Joins are merge joins by hint where both sides grow with the papers: Spark takes a side for small by its compressed
files, and a table that is broadcast goes through the driver whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.text import let, norm, normed_words, words
from gradeloom.sources.scratch import stored

MIN_QUESTION, MIN_OPTION = 0.55, 0.6
#: Candidate pairs of two papers that one task sorts.
MOST_PAIRS = 200_000
# Fixed value: words that must agree in short code options.
QUALIFIER = "^(?:only|both|neither|nor|all|none|and|or)$"


def bag(found: Column) -> Column:
    """Words as distinct tokens (word, occurrence number), so that bags are plain sets."""
    return let(F.array_sort(found), lambda w: F.transform(w, lambda x, i: F.concat_ws("#", x, (i - F.array_position(w, x) + 1).cast("string"))))


def dice(a: Column, b: Column) -> Column:
    """2 |a and b| / (|a| + |b|) of two token sets; 0 when both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total > 0, F.lit(2.0) * F.size(F.array_intersect(a, b)) / total).otherwise(F.lit(0.0))


def prepare(questions: DataFrame) -> DataFrame:
    """paper_id, qid, pos, num, answer, options and the token sets of stem and of stem with options."""
    both = F.concat_ws(" ", "text", F.array_join("options", " "))
    return questions.select("paper_id", "qid", "pos", "num", "answer", "options", bag(words(F.col("text"))).alias("stem"), bag(words(both)).alias("all"))


def _score() -> Column:
    """The score of a pair of questions with t_stem, t_all, s_stem and s_all."""
    return F.lit(0.7) * dice(F.col("t_stem"), F.col("s_stem")) + F.lit(0.3) * dice(F.col("t_all"), F.col("s_all"))


def _share(d: float) -> float:
    """The share of a set that a set of Dice d to it must have in common with it, whatever their sizes."""
    return d / (2 - d)


def rare_tokens(rows: DataFrame, key: list[str], tokens: str, d: float, counts: DataFrame) -> DataFrame:
    """key, size and token, a row for each of the rarest tokens of which a set of Dice d must share one.

    Of n tokens in one order for all sets, those are the first n - ceil(n d / (2 - d)) + 1.
    """
    each = rows.select(*key, F.size(tokens).alias("size"), F.explode(tokens).alias("token")).join(counts.hint("merge"), "token")
    need = F.ceil(F.lit(_share(d)) * F.col("size") - 1e-9)
    place = F.row_number().over(Window.partitionBy(*key).orderBy("n", "token"))
    return each.withColumn("place", place).where(F.col("place") <= F.col("size") - F.greatest(need, F.lit(1)) + 1).select(*key, "size", "token")


def similar_pairs(target: DataFrame, source: DataFrame, paired: Column | None = None, min_question: float = MIN_QUESTION, asked: DataFrame | None = None) -> DataFrame:
    """t, s and score of question pairs with .7 dice(stem) + .3 dice(stem and options) >= .8 min_question.

    target and source come from prepare(), source with keyed questions only; paired is a condition on
    t_paper and s_paper, asked a table of the pairs of papers in question. A pair's stems must reach Dice
    (.8 min_question - .3) / .7, so only the rarest tokens of a stem are joined, which leaves out the words
    that every question has, and loses nothing. For min_question up to .375 that bound is nought: any common
    stem token counts, and pairs without one must be alike in stem and options together, which has an index
    of its own. What is joined are ids; token sets meet for the candidate pairs alone.
    """
    floor = min_question * 0.8
    if floor <= 0:
        raise ValueError("min_question must be above 0: else all pairs match")

    def met(tokens: str, d: float) -> DataFrame:
        counts = target.select(tokens).unionByName(source.select(tokens)).select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        one, two = (rare_tokens(x, ["qid", "paper_id"], tokens, d, counts).withColumnsRenamed({"qid": side, "paper_id": f"{side}_paper", "size": f"{side}_size"}) for x, side in ((target, "t"), (source, "s")))
        both = one.join(two.hint("merge"), "token") if asked is None else one.join(asked.select("t_paper", "s_paper").distinct().hint("merge"), "t_paper").join(two.hint("merge"), ["s_paper", "token"])
        close = F.least("t_size", "s_size") >= F.lit(_share(d) - 1e-9) * F.greatest("t_size", "s_size")
        return both.where(close & (F.lit(True) if paired is None else paired)).select("t", "s")

    pairs = met("stem", max(0.0, (floor - 0.3) / 0.7))
    if floor <= 0.3:
        pairs = pairs.union(met("all", floor / 0.3))
    pairs = pairs.distinct()
    one = target.select(F.col("qid").alias("t"), F.col("paper_id").alias("t_paper"), F.col("pos").alias("t_pos"), F.col("num").alias("t_num"), F.col("stem").alias("t_stem"), F.col("all").alias("t_all"))
    two = source.select(F.col("qid").alias("s"), F.col("paper_id").alias("s_paper"), F.col("pos").alias("s_pos"), F.col("stem").alias("s_stem"), F.col("all").alias("s_all"))
    full = pairs.join(one.hint("merge"), "t").join(two.hint("merge"), "s")
    return full.withColumn("score", _score()).where(F.col("score") >= floor).select("t", "s", "t_paper", "s_paper", "t_pos", "s_pos", "t_num", "score")


def assign(pairs: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """Greedy one-to-one choice within each pair of papers: best score first, then target, then source order.

    The candidate pairs of two papers are counted first. Up to `most` are one group of one task; pairs of
    papers with more are dealt with by assign_by_rounds(), which chooses the same.
    """
    papers = ["t_paper", "s_paper"]
    large = stored(pairs.groupBy(*papers).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*papers), "large_pairs")
    if large.isEmpty():
        return _assign_small(pairs)
    return _assign_small(pairs.join(large, papers, "left_anti")).unionByName(assign_by_rounds(pairs.join(large, papers, "left_semi")))


def _assign_small(pairs: DataFrame) -> DataFrame:
    """The choice for pairs of papers that one task can hold."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["score", "t_pos", "s_pos"], ascending=[False, True, True], kind="stable")
        used_t, used_s, keep = set(), set(), []
        for t, s in zip(rows["t"], rows["s"], strict=True):
            free = t not in used_t and s not in used_s
            keep.append(free)
            if free:
                used_t.add(t)
                used_s.add(s)
        return rows[keep]

    return pairs.groupBy("t_paper", "s_paper").applyInPandas(work, pairs.schema)


def assign_by_rounds(pairs: DataFrame, save=lambda df: stored(df, "rounds")) -> DataFrame:
    """The same choice for pairs of papers too large for one task.

    Each round takes the pairs that are first for both of their questions and drops what they use.
    """
    chosen, left = None, pairs
    while True:
        by_t = Window.partitionBy("t_paper", "s_paper", "t").orderBy(F.desc("score"), "t_pos", "s_pos")
        by_s = Window.partitionBy("t_paper", "s_paper", "s").orderBy(F.desc("score"), "t_pos", "s_pos")
        now = save(left.withColumn("_a", F.row_number().over(by_t)).withColumn("_b", F.row_number().over(by_s)))
        best = now.where("_a = 1 AND _b = 1").drop("_a", "_b")
        chosen = best if chosen is None else chosen.unionByName(best)
        rest = now.drop("_a", "_b").join(best.select("t_paper", "s_paper", "t"), ["t_paper", "s_paper", "t"], "left_anti")
        left = save(rest.join(best.select("t_paper", "s_paper", "s"), ["t_paper", "s_paper", "s"], "left_anti").select(pairs.columns))
        if left.isEmpty():
            return chosen


def option_parts(option: Column) -> Column:
    """What option texts are compared by: normalised text, digits, whether it is a list code, qualifiers, tokens."""
    def parts(x: Column) -> Column:
        digits = F.regexp_replace(x, r"\D", "")
        qualifiers = F.array_join(F.filter(F.split(x, " "), lambda w: w.rlike(QUALIFIER)), " ")
        coded = (F.length(digits) >= 3) & x.rlike(r"[a-d]\s*\d")
        return F.struct(x.alias("x"), digits.alias("digits"), coded.alias("coded"), qualifiers.alias("qualifiers"), bag(normed_words(x)).alias("bag"))

    return let(norm(option), parts)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two options by their parts, 0 to 1; the first rule that fits decides.

    Nothing readable: 0. Equal after norm: 1. List codes must agree digit for digit. Short options with
    numbers must agree on numbers and qualifiers. Else the words' Dice, .9 at most.
    """
    same = a["digits"] == b["digits"]
    short = (a["digits"] != "") & (b["digits"] != "") & (F.length(a["x"]) < 40) & (F.length(b["x"]) < 40)
    return (
        F.when((a["x"] == "") | (b["x"] == ""), F.lit(0.0)).when(a["x"] == b["x"], F.lit(1.0))
        .when(a["coded"] & b["coded"], F.when(same, F.lit(0.95)).otherwise(F.lit(0.0)))
        .when(short, F.when(same & (a["qualifiers"] == b["qualifiers"]), F.lit(0.95)).otherwise(F.lit(0.2)))
        .otherwise(F.least(F.lit(0.9), dice(a["bag"], b["bag"])))
    )


def option_similarity(a: Column, b: Column) -> Column:
    """Likeness of two option texts, 0 to 1."""
    return likeness(option_parts(a), option_parts(b))


def decide(chosen: DataFrame, target: DataFrame, source: DataFrame, min_question: float = MIN_QUESTION, min_option: float = MIN_OPTION) -> DataFrame:
    """t, s, papers, t_num, score, matched and the copied answer (null: unsure) of each chosen pair.

    The best option wins when it is good enough and clearly ahead; else the one unreadable option wins
    when none of the readable ones can be meant. A position is never copied.
    """
    t = target.select(F.col("qid").alias("t"), F.transform("options", option_parts).alias("t_options"))
    want = option_parts(F.coalesce(F.get("options", F.col("answer").cast("int")), F.lit("")))
    s = source.select(F.col("qid").alias("s"), F.size("options").alias("s_size"), want.alias("want"))
    # options are taken apart once a question, on either side, before they meet
    t, s = t.repartition("t"), s.repartition("s")
    rows = chosen.join(t.hint("merge"), "t").join(s.hint("merge"), "s").withColumn("matched", F.col("score") >= min_question)
    sims = F.transform("t_options", lambda o: likeness(F.col("want"), o))
    rows = rows.withColumn("sims", F.when(F.col("matched"), sims))
    ranked = F.array_sort(F.transform("sims", lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    rows = rows.withColumn("ranked", ranked)
    best, runner = -F.get("ranked", F.lit(0))["v"], -F.get("ranked", F.lit(1))["v"]
    clear = runner.isNull() | (best - runner >= 0.1) | ((best == 1) & (runner < 1))
    blank = F.filter(F.transform("t_options", lambda o, i: F.when(F.length(o["x"]) < 3, i)), lambda i: i.isNotNull())
    others = F.transform(F.arrays_zip("t_options", "sims"), lambda z: (F.length(z["t_options"]["x"]) < 3) | (z["sims"] < 0.5))
    left = (F.size("t_options") == F.col("s_size")) & (F.size(blank) == 1) & F.forall(others, lambda ok: ok)
    answer = F.when((best >= min_option) & clear, F.get("ranked", F.lit(0))["i"]).when(left, F.element_at(blank, 1))
    return rows.select("t", "s", "t_paper", "s_paper", "t_num", "score", "matched", F.when(F.col("matched"), answer).alias("answer"))


def transfer(target: DataFrame, source: DataFrame, paired: Column | None = None, min_question: float = MIN_QUESTION, min_option: float = MIN_OPTION, asked: DataFrame | None = None) -> DataFrame:
    """decide() for every pair of papers in question; tables as for similar_pairs(), before prepare()."""
    return _transfer(prepare(target), prepare(source.where("answer IS NOT NULL")), paired, min_question, min_option, asked)


def _transfer(t: DataFrame, s: DataFrame, paired: Column | None, min_question: float, min_option: float, asked: DataFrame | None) -> DataFrame:
    pairs = stored(similar_pairs(t, s, paired, min_question, asked), "similar_pairs")
    return decide(assign(pairs), t, s, min_question, min_option)


def summary(decided: DataFrame, target: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked pair of papers (t_paper, s_paper): matched, copied, unsure and unmatched question numbers.

    Of papers without any pair of questions, nothing matches and all numbers are unmatched.
    """
    each = decided.groupBy("t_paper", "s_paper").agg(
        F.count_if("matched").alias("matched"), F.count("answer").alias("copied"),
        F.array_sort(F.collect_set(F.when(F.col("answer").isNull(), F.col("t_num")))).alias("unsure"), F.collect_set("t").alias("_met"),
    )
    every = target.groupBy(F.col("paper_id").alias("t_paper")).agg(F.collect_list(F.struct("num", "qid")).alias("_all"))
    lost = F.filter("_all", lambda q: ~F.coalesce(F.array_contains("_met", q["qid"]), F.lit(False)))
    rows = asked.select("t_paper", "s_paper").distinct().join(each.hint("merge"), ["t_paper", "s_paper"], "left").join(every.hint("merge"), "t_paper")
    none = F.array().cast("array<int>")
    return rows.select(
        "t_paper", "s_paper", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("matched", "copied")),
        F.coalesce("unsure", none).alias("unsure"), F.array_sort(F.transform(lost, lambda q: q["num"])).alias("unmatched"),
    )


def copied(decided: DataFrame) -> DataFrame:
    """t_paper, s_paper and how many answers the one gets from the other."""
    return decided.groupBy("t_paper", "s_paper").agg(F.count("answer").alias("copied"))


def best_source(copies: DataFrame, target: DataFrame, least: float = 0.3) -> DataFrame:
    """For each target paper the other paper that gives most answers (of copied()), at least this share of its questions."""
    size = target.groupBy(F.col("paper_id").alias("t_paper")).agg(F.count(F.lit(1)).alias("questions"))
    order = Window.partitionBy("t_paper").orderBy(F.desc("copied"), "s_paper")
    best = copies.where("t_paper != s_paper").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return best.join(size.hint("merge"), "t_paper").where(F.col("copied") >= least * F.col("questions"))


def option_keys(parts: DataFrame, key: list[str], counts: DataFrame, min_option: float) -> DataFrame:
    """key, part and option_key, of which two options share one if their likeness is min_option or more; part comes from option_parts().

    Equal texts share the text; list codes and short options with numbers the digits; all others one of the
    rarest words, as in rare_tokens().
    """
    known = parts.where("part.x != ''")
    kept = known.select(*key, F.explode(F.array(F.concat(F.lit("="), "part.x"), F.when(F.col("part.digits") != "", F.concat(F.lit("#"), "part.digits")))).alias("option_key")).where("option_key IS NOT NULL")
    rare = rare_tokens(known.select(*key, "part.bag"), key, "bag", min_option, counts)
    return kept.unionByName(rare.select(*key, F.concat(F.lit("~"), "token").alias("option_key")))


def _possible(t: DataFrame, s: DataFrame, need: DataFrame, known: DataFrame, min_question: float, min_option: float) -> DataFrame:
    """t_paper, s_paper of all pairs of papers, but known ones, that could give as many answers as need (t_paper, need) says.

    An answer is copied only from a question worded alike whose right option is like one of the target's, or if
    one option of the target is unreadable. Each source question gives one answer at most, so a source with k keyed questions
    that is to give n of them must have one that fits among its k - n + 1 rarest right options, and j among the
    k - n + j rarest. The first look for papers by option keys; of the papers found so, more are counted.
    """
    options = t.select(F.col("paper_id").alias("t_paper"), F.col("qid").alias("t"), F.posexplode(F.transform("options", option_parts)).alias("i", "part"))
    wants = s.select(F.col("paper_id").alias("s_paper"), F.col("qid").alias("s"), option_parts(F.coalesce(F.get("options", F.col("answer").cast("int")), F.lit(""))).alias("part"))
    options, wants = stored(options, "options"), stored(wants, "wants")
    blanks = options.groupBy("t_paper", "t").agg(F.count_if(F.length("part.x") < 3).alias("n")).groupBy("t_paper").agg(F.count_if(F.col("n") == 1).alias("blank"))
    due = stored(need.join(blanks, "t_paper", "left").select("t_paper", "need", (F.col("need") - F.coalesce("blank", F.lit(0))).alias("due")), "due")
    other = F.col("t_paper") != F.col("s_paper")
    any_source = due.where("due < 1") if min_option > 0.2 else due  # nothing tells their sources apart but the questions
    loose = similar_pairs(t.join(any_source.select(F.col("t_paper").alias("paper_id")), "paper_id", "left_semi"), s, other, min_question)
    loose = loose.groupBy("t_paper", "s_paper").agg(F.count_distinct("t").alias("n")).join(any_source, "t_paper").where("n >= need").select("t_paper", "s_paper")
    if min_option <= 0.2:
        return loose
    counts = options.select("part.bag").unionByName(wants.select("part.bag")).select(F.explode("bag").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    o = stored(option_keys(options, ["t_paper", "t", "i"], counts, min_option), "option_keys")
    w = stored(option_keys(wants, ["s_paper", "s"], counts, min_option), "want_keys")
    common = w.join(o.groupBy("option_key").agg(F.count(F.lit(1)).alias("n")), "option_key", "left").groupBy("s").agg(F.sum("n").alias("company"))
    size = Window.partitionBy("s_paper")
    placed = wants.select("s_paper", "s").join(common, "s", "left").withColumns({"place": F.row_number().over(size.orderBy(F.coalesce("company", F.lit(0)), "s")), "keyed": F.count(F.lit(1)).over(size)})
    lowest = due.where("due > 0").agg(F.min("due")).first()[0] or 1
    w = stored(w.join(placed.select("s", "place", "keyed"), "s"), "want_keys")
    due = due.where("due > 0")
    alike = likeness(F.col("want"), F.col("part")) >= min_option

    def fitting(met: DataFrame) -> DataFrame:
        """Of questions whose option keys met, those with options and wording alike."""
        met = met.select("t_paper", "t", "i", "s_paper", "s").distinct()
        met = met.join(options, ["t_paper", "t", "i"]).join(wants.select("s", F.col("part").alias("want")), "s").where(alike)
        one, two = (x.select(F.col("qid").alias(c), F.col("stem").alias(f"{c}_stem"), F.col("all").alias(f"{c}_all")) for x, c in ((t, "t"), (s, "s")))
        return met.select("t_paper", "t", "s_paper", "s").distinct().join(one, "t").join(two, "s").where(_score() >= min_question).select("t_paper", "s_paper", "s")

    met = w.where(F.col("place") <= F.col("keyed") - lowest + 1).join(o.join(due, "t_paper"), "option_key")
    found = stored(fitting(met.where(other & (F.col("place") <= F.col("keyed") - F.col("due") + 1))).select("t_paper", "s_paper").distinct().join(known, ["t_paper", "s_paper"], "left_anti"), "found_papers")
    for more in (6, None):  # of the k - n + 6 rarest, six must fit, and in the end n of all
        rows = found.join(due, "t_paper").join(w, "s_paper")
        rows = rows if more is None else rows.where(F.col("place") <= F.col("keyed") - F.col("due") + more)
        enough = F.col("due") if more is None else F.least("due", F.lit(more))
        counted = fitting(rows.join(o, ["t_paper", "option_key"])).groupBy("t_paper", "s_paper").agg(F.count_distinct("s").alias("n"))
        found = stored(counted.join(due, "t_paper").where(F.col("n") >= enough).select("t_paper", "s_paper"), "found_papers")
    return found.unionByName(loose)


def _guesses(t: DataFrame, s: DataFrame, tries: int, most: int = 100) -> DataFrame:
    """t_paper, s_paper: for each paper the `tries` others that share most questions with the same three rarest words.

    What very many source questions share tells nothing and is left out: guesses save work and decide nothing.
    """
    counts = t.select("stem").unionByName(s.select("stem")).select(F.explode("stem").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))

    def named(rows: DataFrame, side: str) -> DataFrame:
        tokens = rows.select("qid", "paper_id", F.explode("stem").alias("token")).join(counts, "token")
        rare = tokens.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "paper_id").orderBy("n", "token"))).where(F.col("_n") <= 3)
        return rare.groupBy(F.col("qid").alias(side), F.col("paper_id").alias(f"{side}_paper")).agg(F.array_join(F.array_sort(F.collect_list("token")), " ").alias("name"))

    source = named(s, "s")
    telling = source.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).select("name")
    shared = named(t, "t").join(source.join(telling, "name", "left_semi"), "name").where("t_paper != s_paper").groupBy("t_paper", "s_paper").agg(F.count_distinct("t").alias("n"))
    order = Window.partitionBy("t_paper").orderBy(F.desc("n"), "s_paper")
    return shared.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= tries).select("t_paper", "s_paper")


def best_sources(target: DataFrame, source: DataFrame, least: float = 0.3, min_question: float = MIN_QUESTION, min_option: float = MIN_OPTION, tries: int = 2) -> DataFrame:
    """t_paper, s_paper, copied and questions: the best key source of every target paper among all other papers.

    Tables as for transfer(), least above 0. First each paper is compared with the `tries` papers that seem most
    alike (see _guesses). What the best of them gives is what any other must give at least, and
    only papers that could (see _possible) are compared as well. So the result is that of comparing all pairs of
    papers, while papers that have nothing rare in common never meet.
    """
    if least <= 0:
        raise ValueError("least must be above 0")
    t, s = stored(prepare(target), "targets"), stored(prepare(source.where("answer IS NOT NULL")), "sources")
    papers = ["t_paper", "s_paper"]
    asked = stored(_guesses(t, s, tries), "asked")
    tried = stored(copied(_transfer(t, s, None, min_question, min_option, asked)), "tried")
    size = t.groupBy(F.col("paper_id").alias("t_paper")).agg(F.ceil(least * F.count(F.lit(1)) - 1e-9).alias("need"))
    need = size.join(tried.groupBy("t_paper").agg(F.max("copied").alias("most")), "t_paper", "left").select("t_paper", F.greatest("need", F.coalesce("most", F.lit(0))).alias("need"))
    rest = stored(_possible(t, s, need, asked, min_question, min_option).distinct().join(asked, papers, "left_anti"), "possible")
    copies = tried if rest.isEmpty() else tried.unionByName(copied(_transfer(t, s, None, min_question, min_option, rest)))
    return best_source(copies, target, least)
