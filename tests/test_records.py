"""Bucketed stores of versioned records, and papers with their index entries."""

from pathlib import Path

from gradeloom.operators import records as R

SCHEMA = "id string, value string, version int, removed boolean"


def files(path):
    return {(p.parent.name, p.name) for p in Path(path).rglob("*.parquet")}


def test_a_merge_rewrites_only_buckets_it_changes(spark, tmp_path):
    store = R.Store(f"file://{tmp_path}/store", "id", SCHEMA, 8)
    store.create(spark.createDataFrame([(f"k{i}", "a", 1, False) for i in range(200)], SCHEMA))
    before = files(tmp_path / "store")
    touched = store.merge(spark.createDataFrame([("k3", "b", 2, False), ("k4", None, 2, True), ("new", "c", 1, None), (None, "d", 1, False)], SCHEMA))
    after = files(tmp_path / "store")
    rewritten = {bucket for bucket, _ in before - after}
    assert rewritten == {f"bucket={b}" for b in touched} and 0 < len(touched) < 5
    want = {f"k{i}": "a" for i in range(200)} | {"k3": "b", "new": "c", None: "d"}
    del want["k4"]
    assert {r.id: r.value for r in store.read(spark).collect()} == want
    assert store.merge(spark.createDataFrame([("k3", "old", 1, False), ("k4", "old", 1, False)], SCHEMA))  # older versions change nothing
    assert {r.id: r.value for r in store.read(spark).collect()} == want
    assert store.merge(spark.createDataFrame([], SCHEMA)) == []


def test_papers_and_entries_are_committed_together(spark, tmp_path):
    questions = spark.createDataFrame([(1, 10, 2, 1, "b", ["x"], None), (1, 11, 1, 0, "a", ["x", "y"], 1), (2, 12, 1, 0, "c", [], 0)], "paper_id long, qid long, num int, pos int, text string, options array<string>, answer int")
    entries = "paper_id long, title string, note string, key_source string, version int, removed boolean"
    store = R.Store(f"file://{tmp_path}/papers", "paper_id", R.PAPERS, 4)
    store.create(R.paper_records(questions, spark.createDataFrame([(1, "One", "", None, 1, None), (2, "Two", "", "printed", 1, False), (3, "Empty", "", None, 1, False)], entries)))
    assert [q.text for q in store.read(spark).where("paper_id = 1").first().questions] == ["a", "b"]
    assert {tuple(r) for r in R.paper_index(store.read(spark)).collect()} == {(1, "One", "", None, 2, 1), (2, "Two", "", "printed", 1, 1), (3, "Empty", "", None, 0, 0)}
    store.merge(R.paper_records(questions.where("qid = 11"), spark.createDataFrame([(1, "One again", "n", "copied", 2, False), (2, "", "", "", 2, True)], entries)))
    assert {tuple(r) for r in R.paper_index(store.read(spark)).collect()} == {(1, "One again", "n", "copied", 1, 1), (3, "Empty", "", None, 0, 0)}
