"""Near copies that are together in most of their groups are a row for a pair, not for each group of a pair."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from gradeloom.llm import near_dups


def _members(spark, limit):
    """Twelve groups of most of 60 nodes, one class of 50 and ten single ones; rows (key, node, class, weight, limit)."""
    rng = np.random.default_rng(3)
    rows = []
    for key in range(12):
        for node in range(60):
            if rng.random() < 0.9:
                rows.append((key, f"n{node:02}", "n00" if node < 50 else f"n{node:02}", 100 + node % 5, 60 - node, float(limit(rng))))
    return rows, spark.createDataFrame(rows, "key long, node string, class string, weight long, pop long, limit double")


def _pairs(spark, limit, most):
    rows, df = _members(spark, limit)
    size = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("heavy"))
    found = near_dups.once(near_dups.placed(df.join(size, "key"), most)).select("node", "head").collect()
    want, of = set(), {}
    for key, node, cls, weight, _, most_weight in rows:
        of.setdefault(key, []).append((node, cls, weight, most_weight))
    for own in of.values():
        for a, b in combinations(own, 2):
            if a[1] != b[1] and a[2] <= b[3] and b[2] <= a[3]:
                want.add(frozenset((a[0], b[0])))
    return [frozenset((r.node, r["head"])) for r in found], want


def test_each_pair_is_one_row_where_limits_rule_out_nobody(spark):
    found, want = _pairs(spark, lambda rng: np.inf, 64)
    assert set(found) == want and len(found) == len(want)


def test_no_pair_is_lost_where_some_limits_rule_out_some(spark):
    found, want = _pairs(spark, lambda rng: rng.choice([100.5, 102.5, 110]), 64)
    assert set(found) == want and len(found) < 3 * len(want)


def test_rounds_with_few_heads_give_all_pairs_in_the_end(spark):
    rows, df = _members(spark, lambda rng: np.inf)
    want, found, most = _pairs(spark, lambda rng: np.inf, 64)[1], set(), 8
    while df.count():
        size = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("heavy"))
        members = near_dups.placed(df.join(size, "key"), most).cache()
        found |= {frozenset((r.node, r["head"])) for r in near_dups.once(members).collect()}
        df, most = spark.createDataFrame(members.where("place is null").select(df.columns).collect(), df.schema), most * 4
    assert found == want
