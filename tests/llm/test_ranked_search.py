"""Ranked search against brute force over all documents and items."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from gradeloom.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def by_hand(docs, items, best=10):
    own = [(i, Counter(terms(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in own:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            score = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:best])]
    return sorted(out, key=str)


def corpus(rng, n):
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)] + ["Été", "été", "ÉTÉ", "Rare", "rare", "x-y", "a_b", "9", "中文", "~"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 20, 90, 400]))) for _ in range(n)]
    return texts + texts[:15] + [None, "", " ,;. ", "W1 " * 3000]


@pytest.mark.parametrize("shard_bytes, block_chars", [(16_000_000, 1_000_000), (4_000, 900), (1, 2_000)])
def test_searches_equal_brute_force(spark, shard_bytes, block_chars):
    rng = random.Random(shard_bytes)
    texts = corpus(rng, 120)
    ids = [*rng.sample(range(-100, 900), len(texts) - 2), None, 5]
    docs = list(zip(ids, texts, strict=True))
    items = [(n, " ".join(rng.choices(" ".join(t for t in texts if t).split(), k=rng.choice([1, 4, 25, 60])))) for n in range(12)] + [(50, None), (51, ""), (52, "nowhere"), (53, "RARE rare w1, w1 w1;w2"), (0, "w3 w4"), (7, "~!")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS term", "2 AS shard", "3 AS score").repartition(3)
    index = R.build_index(df, shard_bytes=shard_bytes).cache()
    assert shard_bytes > 4000 or index.where("term IS NULL").count() > 10
    queries = spark.createDataFrame(items + items[:2], "item_id int, text string")
    got = sorted(((r.item, r.rank, r.id, r.score) for r in R.search(index, queries, block_chars=block_chars).collect()), key=str)
    assert got == by_hand(docs, items)


def test_whole_query(spark, tmp_path):
    rng = random.Random(8)
    docs = list(enumerate(corpus(rng, 60)))
    items = [(f"i{n}", " ".join(rng.choices(docs[n][1].split(), k=9))) for n in range(8)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    rows = R.op11_ranked_search(spark, f"file://{tmp_path}").collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rows), key=str) == by_hand(docs, items)


def test_max_score_equals_full_sums():
    """Ties included, for lists of any length and few or many documents."""
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.choice([1, 5, 12, 60, 500]))
        lists, total = [], np.zeros(n, np.int64)
        for _ in range(int(rng.integers(0, 9))):
            places = np.flatnonzero(rng.random(n) < rng.choice([0.02, 0.3, 0.9]))
            if len(places):
                own = rng.integers(1, int(rng.choice([2, 5, 1000])), len(places)) * int(rng.choice([1, 50]))
                lists.append((places, own))
                total[places] += own
        places, scores = R.max_score(lists, n)
        want = sorted(((-int(s), i) for i, s in enumerate(total) if s > 0))[:10]
        assert [(-int(s), int(p)) for p, s in zip(places, scores, strict=True)] == want


def test_defined_cases(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    index = R.build_index(docs)
    assert R.search(index, items.where("false")).count() == 0
    assert R.search(R.build_index(docs.where("false")), items).count() == 0
    assert R.search(R.build_index(docs.selectExpr("doc_id", "CAST(NULL AS STRING) AS text")), items).count() == 0
    assert [tuple(r) for r in R.search(index, items).collect()] == [(1, 1, 1, R.search(index, items).first().score)]
