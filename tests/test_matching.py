import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import matching as M

AR = ["Both (A) and (R) are true and (R) is the correct explanation of (A)", "(A) is false, but (R) is true", "Both (A) and (R) are true, but (R) is not the correct explanation of (A)", "(A) is true, but (R) is false"]
A1 = "Which of the following sites were obtained under the Treaty of Sugauli in 1816?"
A2 = "Assertion (A): The interior part of Australia is desert. Reason (R): Northern Australia is in the temperate zone."
A3 = "Match List-I (Coal Field) with List-II (Country): Appalachian, Lancashire, Ruhr, Kuzbass"
SCHEMA = "paper_id string, qid string, num int, pos int, text string, options array<string>, answer int"
SOURCE = [
    ("A", "a1", 1, 0, A1, ["1 and 2", "2, 3 and 4", "Only 3 and 4", "Only 1"], 1), ("A", "a2", 2, 1, A2, AR, 3),
    ("A", "a3", 3, 2, A3, ["A-4, B-1, C-2, D-3", "A-1, B-4, C-3, D-2", "A-1, B-4, C-2, D-3", "A-4, B-1, C-3, D-2"], 0),
]
TARGET = [
    ("B", "b1", 1, 0, A3, ["A-1, B-4, C-3, D-2", "A-4, B-1, C-3, D-2", "A-4, B-1, C-2, D-3", "A-1, B-4, C-2, D-3"], None),
    ("B", "b2", 2, 1, "Given below are two statements. " + A2, [AR[2], AR[3], AR[1], AR[0]], None),
    ("B", "b3", 3, 2, A1 + " ?", ["land2", "", "Only 3 and 4", "Only l"], None), ("B", "b4", 4, 3, "Who wrote Gitanjali?", ["Tagore", "Premchand", "Nirala", "Prasad"], None),
]


def test_versions_of_a_paper(spark):
    t, s = spark.createDataFrame(TARGET, SCHEMA), spark.createDataFrame(SOURCE, SCHEMA)
    decided = M.transfer(t, s).cache()
    assert {r.t: r.answer for r in decided.collect()} == {"b1": 2, "b2": 1, "b3": 1}
    asked = spark.createDataFrame([("B", "A"), ("B", "A"), ("B", "nobody")], "t_paper string, s_paper string")
    got = {r.s_paper: (r.matched, r.copied, r.unsure, r.unmatched) for r in M.summary(decided, t, asked).collect()}
    assert got == {"A": (3, 3, [], [4]), "nobody": (0, 0, [], [1, 2, 3, 4])}
    assert M.best_source(M.copied(decided), t).first().s_paper == "A"


def library(rng, papers):
    """Papers that share questions, reworded or not, with some keys, short, unreadable and missing options."""
    stems = [" ".join(rng.choices("who made which river king first war treaty 1816 statements about the of land 12 i".split(), k=rng.randrange(1, 14))) for _ in range(14)] + [""]
    options = ["1 and 2", "only 1", "Only 2 and 3", "both 1 and 2", "A-1, B-2, C-3", "A-2, B-1, C-3", "the red river bank", "red river", "a red bank", "", "x", "blue sea of the north", None]
    rows = []
    for p in range(papers):
        for n in range(rng.randrange(1, 8)):
            own = rng.choices(options[:-1], k=rng.choice([2, 4, 4, 5]))
            if rng.random() < 0.3:
                own[rng.randrange(len(own))] = rng.choice(["", "-"])
            rows.append((p, 100 * p + n, n + 1, n, rng.choice(stems), own, rng.choice([None, 0, 1, 1, 6])))
    return rows


def test_best_sources_equal_all_pairs_of_papers(spark):
    """Bounds, guesses and option keys lose nothing, and no paper is its own source."""
    rng, schema = random.Random(11), SCHEMA.replace("paper_id string, qid string", "paper_id long, qid long")
    for least, min_question, min_option, tries in ((0.3, 0.55, 0.6, 2), (0.15, 0.3, 0.15, 1)):
        df = spark.createDataFrame(library(rng, 22), schema).cache()
        got = M.best_sources(df, df, least, min_question, min_option, tries)
        want = M.best_source(M.copied(M.transfer(df, df, F.col("t_paper") != F.col("s_paper"), min_question, min_option)), df, least)
        rows = {tuple(r) for r in got.select("t_paper", "s_paper", "copied", "questions").collect()}
        assert rows == {tuple(r) for r in want.select("t_paper", "s_paper", "copied", "questions").collect()} and all(t != s for t, s, *_ in rows)
        assert len(rows) > 2
    assert M.best_sources(df.where("false"), df).count() == 0


def test_best_source_is_never_the_paper_itself(spark):
    """A paper with keyed questions copies best from itself, but its source is another one."""
    both = spark.createDataFrame(SOURCE + [("C", *r[1:]) for r in SOURCE[:2]] + TARGET, SCHEMA).withColumn("qid", F.concat("paper_id", "qid"))
    assert {(r.t_paper, r.s_paper, r.copied) for r in M.best_sources(both, both).collect()} == {("A", "C", 2), ("C", "A", 2), ("B", "A", 3)}


def by_hand(t, s):
    x, y = Counter(t), Counter(s)
    return 2 * sum((x & y).values()) / (len(t) + len(s)) if t or s else 0.0


def test_pairs_at_any_threshold(spark):
    """Also pairs without a common word in their stems, against all pairs."""
    rng, schema = random.Random(6), SCHEMA.replace("paper_id string, qid string", "paper_id long, qid long")
    vocabulary = [f"word{i}" for i in range(14)]
    rows = [(i % 3, i, i, i, " ".join(rng.choices(vocabulary, k=rng.randrange(6))), [" ".join(rng.choices(vocabulary, k=rng.randrange(5))) for _ in range(4)], 1) for i in range(90)]
    stems = {r[1]: [w for t in r[4].split() for w in ("word", t[4:])] for r in rows}
    every = {r[1]: stems[r[1]] + [w for o in r[5] for t in o.split() for w in ("word", t[4:])] for r in rows}
    t, s = (M.prepare(spark.createDataFrame(x, schema)) for x in (rows[:45], rows[45:]))
    scores = {(a, b): 0.7 * by_hand(stems[a], stems[b]) + 0.3 * by_hand(every[a], every[b]) for a in range(45) for b in range(45, 90)}
    sizes = set()
    for least in (0.1, 0.375, 0.55, 0.9):
        got = {(r.t, r.s) for r in M.similar_pairs(t, s, min_question=least).collect()}
        assert got == {p for p, score in scores.items() if score >= least * 0.8}
        sizes.add(len(got))
    assert len(sizes) > 2
    with pytest.raises(ValueError):
        M.similar_pairs(t, s, min_question=0)


def test_rounds_equal_greedy(spark):
    rng = random.Random(4)
    rows = list({(t, s): (f"t{t}", f"s{s}", "T", "S", t, s, t, rng.choice([0.5, 0.6, 0.7, 0.8])) for t, s in ((rng.randrange(12), rng.randrange(12)) for _ in range(70))}.values())
    pairs = spark.createDataFrame(rows, "t string, s string, t_paper string, s_paper string, t_pos int, s_pos int, t_num int, score double")
    want = {(r.t, r.s) for r in M.assign(pairs).collect()}
    assert {(r.t, r.s) for r in M.assign_by_rounds(pairs).collect()} == want
    other = pairs.where("t_pos < 4").withColumn("s_paper", F.lit("U"))
    mixed = {(r.s_paper, r.t, r.s) for r in M.assign(pairs.unionByName(other), most=other.count()).collect()}  # the larger group by rounds
    assert mixed == {("S", *p) for p in want} | {("U", r.t, r.s) for r in M.assign(other).collect()}
    used = set()
    for r in sorted(rows, key=lambda r: (-r[7], r[4], r[5])):
        if r[0] not in used and r[1] not in used:
            used |= {r[0], r[1]}
            assert (r[0], r[1]) in want


def test_option_rules(spark):
    cases = [("", "x", 0.0), ("Only 1", "only  1.", 1.0), ("A-4, B-1, C-2", "A-1, B-4, C-2", 0.0), ("Only 1 and 3", "1 and 3 only", 0.2), ("2, 3 and 4", "2 3 and 4", 1.0), (AR[1], AR[3], 0.9)]
    df = spark.createDataFrame(cases, "a string, b string, want double").withColumn("got", M.option_similarity(F.col("a"), F.col("b")))
    for r in df.collect():
        assert abs(r.got - r.want) < 1e-9, r
