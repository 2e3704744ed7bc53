"""Keys that members of groups do not share are dropped before they become rows; shared ones never are."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gradeloom.llm import near_dups


def test_shared_keys_are_those_of_two_members(spark):
    rng = np.random.default_rng(5)
    hot = [int(x) for x in rng.integers(-(2**63), 2**63, 50)]
    rows = [(n, [int(x) for x in rng.integers(-(2**63), 2**63, 40)] + (hot if n % 3 == 0 else [])) for n in range(300)] + [(300, []), (301, [hot[0]]), (302, [hot[0]])]
    members = spark.createDataFrame(rows, "n long, keys array<long>").repartition(7)
    times = Counter(k for _, keys in rows for k in keys)
    left = {r.n: r["keys"] for r in near_dups.shared_keys(members).collect()}
    assert set(left) == {n for n, _ in rows}
    kept = 0
    for n, keys in rows:
        assert set(left[n]) <= set(keys)
        assert {k for k in keys if times[k] > 1} <= set(left[n])
        kept += sum(times[k] == 1 for k in left[n])
    assert kept <= 0.2 * sum(v == 1 for v in times.values())


def test_shared_keys_of_no_rows_and_of_too_many(spark, monkeypatch):
    none = spark.createDataFrame([], "n long, keys array<long>")
    assert near_dups.shared_keys(none).count() == 0
    monkeypatch.setattr(near_dups, "SKETCHED", 4)
    members = spark.createDataFrame([(1, [1, 2, 3]), (2, [4, 5, 6])], "n long, keys array<long>")
    assert near_dups.shared_keys(members).select(F.explode("keys")).count() == 6
