"""The bound of the rows that the trees of personal data are fitted on."""

from pyspark.sql import functions as F

from gradeloom.llm import pii


def test_repeated_ids_stay_within_the_bound(spark):
    rows = [(i % 3, f"text {i % 40}") for i in range(400)] + [(None, "none"), (None, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.sampled(df, "doc_id", "text", 5).count() <= 5
    every = pii.sampled(df, "doc_id", "text", 10_000)
    assert sorted(map(tuple, every.collect()), key=str) == sorted(set(rows), key=str)
    one = spark.createDataFrame([(i, "a") for i in range(50)], "doc_id long, text string")  # of rows with ids of their own, those of least id hash
    want = {r.doc_id for r in one.orderBy(F.xxhash64("doc_id")).limit(8).collect()}
    assert {r.doc_id for r in pii.sampled(one, "doc_id", "text", 8).collect()} == want
    assert pii.train(df.where("false")) is None
