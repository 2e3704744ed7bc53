import pytest
from pyspark.sql import functions as F

from gradeloom.operators import keys as K
from gradeloom.operators import library as L

CASES = [
    ("1-a, 2-c, 3 d, 4.(b)", {1: 0, 2: 2, 3: 3, 4: 1}), ("Q1: 3\nQ2: 1\n10) 4", {1: 2, 2: 0, 10: 3}),
    ("1 2 3 4\nb a d c\n5 6\nc c", {1: 1, 2: 0, 3: 3, 4: 2, 5: 2, 6: 2}), ("abdc", {1: 0, 2: 1, 3: 3, 4: 2}),
    ("b\nd\n1\n(c)", {1: 1, 2: 3, 3: 0, 4: 2}), ("", {}), ("  \n", {}), (None, {}), ("1 2 3 4\nb a d c", {i + 1: x for i, x in enumerate([0, 1, 2, 3, 1, 0, 3, 2])}),
]


@pytest.fixture(scope="module")
def read(spark):
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "paper_id int, text string")
    out = [{} for _ in CASES]
    for r in K.key_rows(texts).collect():
        out[r.paper_id][r.num] = r.idx
    return out


@pytest.mark.parametrize("n", range(len(CASES)))
def test_reads(read, n):
    assert read[n] == CASES[n][1]


def test_tabular_reader(spark):
    t = spark.createDataFrame([(1, "1 2 3 4\nb a d c\n2 3\nd d")], "paper_id int, text string")
    assert {(r.num, r.idx) for r in K.key_rows(t, "tabular").collect()} == {(1, 1), (2, 3), (3, 3), (4, 2)}


def test_repeated_number_and_modes(spark):
    q = spark.createDataFrame([(1, "a", 1, 0, None), (1, "b", 1, 1, 2), (1, "c", 2, 2, 3)], "paper_id int, qid string, num int, pos int, answer int")
    key = spark.createDataFrame([(1, 1, 0), (1, 9, 1)], "paper_id int, num int, idx int")
    assert {r.qid: r.answer for r in K.apply_key(q, key).collect()} == {"a": None, "b": 0, "c": 3}
    assert [r.num for r in K.unknown_numbers(q, key).collect()] == [9]
    copied = spark.createDataFrame([("a", 1), ("c", 1)], "qid string, idx int")
    assert {r.qid: r.answer for r in K.copy_answers(q, copied, "fill").collect()} == {"a": 1, "b": 2, "c": 3}
    assert {r.qid: r.answer for r in K.copy_answers(q, copied).collect()} == {"a": 1, "b": 2, "c": 1}
    assert K.format_key(q).first().text == "1-3, 2-4"


def test_papers_round_trip(spark, tmp_path):
    papers = spark.createDataFrame([("p1", "T", [("q1-0", 1, [("p", "What?", None)], ["a", "b"], 1, [])]), ("p2", "U", [])], L.PAPER.replace("id STRING, title STRING, note STRING, pageCount INT, keySource STRING", "id STRING, title STRING", 1))
    papers.coalesce(1).where("id = 'p1'").write.json(f"file://{tmp_path}/papers")
    rows = L.read_papers(spark, f"file://{tmp_path}/papers").collect()
    assert [(r.paper_id, r.pos, r.num, r.answer, r.options) for r in rows] == [("p1", 0, 1, 1, ["a", "b"])]
    L.write_papers(papers.withColumnRenamed("id", "paper_id"), f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2


def test_repeated_key_and_copy_rows_keep_questions_single(spark):
    q = spark.createDataFrame([("p", 1, 0, "q1", 3), ("p", 2, 1, "q2", None), ("p", 2, 2, "q3", None)], "paper_id string, num int, pos int, qid string, answer int")
    key = spark.createDataFrame([("p", 1, 2), ("p", 1, 1), ("p", 2, 0), ("p", 2, 0)], "paper_id string, num int, idx int")
    assert {r.qid: r.answer for r in K.apply_key(q, key).collect()} == {"q1": 1, "q2": None, "q3": 0} and K.apply_key(q, key).count() == 3
    copied = spark.createDataFrame([("q1", 2), ("q1", 0), ("q2", 1)], "qid string, idx int")
    assert sorted((r.qid, r.answer) for r in K.copy_answers(q, copied).collect() if r.qid != "q3") == [("q1", 0), ("q2", 1)]
    edits = spark.createDataFrame([("q1", 2, 3), ("q1", 1, 2), ("q2", 1, 1), ("q2", 2, 1), ("q3", 1, None)], "qid string, seq int, option int")
    assert {r.qid: r.answer for r in K.toggle_answers(q, edits).collect()} == {"q1": 3, "q2": None, "q3": None}


def test_stems_to_edit_and_back(spark):
    text = "First.\n A | b \nC | d\n\n \nLast | not a table row?"
    df = spark.createDataFrame([(text,)], "t string").select(L.stem_of_text(F.col("t")).alias("s")).withColumn("back", L.text_of_stem(F.col("s")))
    r = df.first()
    assert [(b.type, b.text, b.rows) for b in r.s] == [("p", "First.", None), ("table", None, [["A", "b"], ["C", "d"], ["Last", "not a table row?"]])]
    assert r.back == "First.\nA | b\nC | d\nLast | not a table row?"


def test_white_space_of_any_script(spark):
    """Pasted keys hold no-break, wide and narrow spaces; a vertical tab and a byte order mark are white space, too."""
    cases = {
        "1 - a, 2 - c": [(1, 0), (2, 2)], "b d a　c": [(1, 1), (2, 3), (3, 0), (4, 2)], "1 2 3 9\n﻿ b d\x0ba c  ": [(1, 1), (2, 3), (3, 0), (9, 2)],
        "Q7. (b) Q8: d": [(7, 1), (8, 3)],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "paper_id int, text string")
    got = {}
    for r in K.key_rows(rows).collect():
        got.setdefault(r.paper_id, []).append((r.num, r.idx))
    assert {i: sorted(v) for i, v in got.items()} == dict(enumerate(cases.values()))
