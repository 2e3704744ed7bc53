"""Near-duplicate classes at thresholds and shingle sizes other than the query's."""

import random

from gradeloom.llm import near_dups as N


def test_bands_follow_the_threshold():
    assert N.banding(0.8) == (24, 5)
    for least in (0.05, 0.1, 0.4, 0.5, 0.7, 0.9, 0.99, 1.0):
        bands, rows = N.banding(least)
        assert (1 - least**rows) ** bands <= 1e-4


def test_edited_pairs_at_low_similarity_are_joined(spark):
    rng = random.Random(4)
    rows, pairs = [], 0
    for i in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        edited = list(words)
        for at in rng.sample(range(120), 14):
            edited[at] = f"v{rng.randrange(9999)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least, size in ((0.4, 3), (0.3, 5)):
        want = set()
        for i in range(120):
            a, b = (N.shingles(rows[2 * i + k][1], size) for k in (0, 1))
            if N.similarity(a, b) >= least:
                want.add(i)
        got = {r.id: r.class_id for r in N.near_classes(df, least=least, size=size).collect()}
        assert {i for i in range(120) if got[2 * i + 1] == 2 * i} == want
        pairs += len(want)
    assert pairs > 60
