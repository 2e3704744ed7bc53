"""The corpus pipeline's stages on a small corpus, each against what it must keep."""

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline as C
from gradeloom.llm import bpe, decontamination, near_dups, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = f"file://{tmp_path_factory.mktemp('corpus')}"
    good = [" ".join(f"river{(i * 7 + k * 3) % 97} runs{(i + k) % 13} hill{k}" for k in range(20)) for i in range(60)]
    bad = [" ".join(f"x{(i * k) % 50}###" for k in range(1, 50)) for i in range(30)]
    leak = good[3] + " one two three four five six seven eight nine ten eleven"
    private = good[5].replace("hill4", "mail me@example.com now")
    texts = [*good, *bad, leak, good[0], private, None, ""]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, "One two, three four five six seven eight nine ten!")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, docs
    for n, (_, stage) in enumerate(C.STAGES):
        before = {r.doc_id: r for r in kept.collect()}
        stage(spark, kept, folder).write.parquet(f"{folder}/stage{n}")
        kept = spark.read.parquet(f"{folder}/stage{n}")
        after = {r.doc_id: r for r in kept.collect()}
        assert set(after) <= set(before) and (n == 4 or kept.columns == columns)
        if n == 0:
            model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            assert set(after) == {r.id for r in quality.score(docs, model).where("score >= 0.3").collect()}
            assert not set(after) & set(range(60, 90)) and set(range(60)) <= set(after)
        if n == 1:
            classes = near_dups.near_classes(spark.read.parquet(f"{folder}/stage0")).collect()
            assert set(after) == {r.class_id for r in classes} and 91 not in after
        if n == 2:
            found = decontamination.occurrences(spark.read.parquet(f"{folder}/stage1"), spark.read.parquet(f"{folder}/benchmark.parquet")).where("size(hit) > 0")
            assert set(before) - set(after) == {r.id for r in found.collect()} and 90 not in after
        if n == 3:
            assert all("me@example.com" not in (r.text or "") for r in after.values()) and len(after) == len(before)
            assert all(r.n_chars == len(r.text) for r in after.values() if r.text is not None)
        if n == 4:
            tree, ids_of = bpe.coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
            assert {i: tree.decode(np.array(r.ids, np.int64)).tobytes().decode() for i, r in after.items()} == {i: r.text or "" for i, r in before.items()}
    assert C.run(spark, folder).count() == len(after)


def test_repeated_ids_and_none(spark, folder):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "q", "z"), (2, None, "w")], "doc_id long, text string, lang string")
    assert sorted((r.doc_id or 0) for r in C.near_duplicates(spark, docs, folder).collect()) == [0, 1, 2]
    assert C.near_duplicates(spark, docs.limit(0), folder).count() == 0
    assert C.private_data(spark, docs.limit(0).selectExpr("*", "0L AS n_chars"), folder).count() == 0


def test_rows_of_one_id_are_judged_each(spark, folder):
    a, b = "a b c d e f g", "h i j k l m n"
    docs = spark.createDataFrame([(3, a, "x"), (5, a, "x"), (5, b, "x"), (9, b, "x"), (None, a, "x"), (None, "o p q", "x")], "doc_id long, text string, lang string")
    assert sorted((str(r.doc_id), r.text) for r in C.near_duplicates(spark, docs, folder).collect()) == [("3", a), ("5", b), ("None", "o p q")]
    leak = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, leak, "x"), (None, a, "x"), (4, leak, "x"), (4, a, "x")], "doc_id long, text string, lang string")
    assert sorted((str(r.doc_id), r.text) for r in C.decontaminate(spark, docs, folder).collect()) == [("4", a), ("None", a)]
