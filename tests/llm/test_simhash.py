"""SimHash fingerprints and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gradeloom.llm import simhash as S


def by_hand(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(prints):
    """The least id that links reach, from {id: fingerprint}."""
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def test_whole_query(spark, tmp_path):
    rng = random.Random(5)
    words = ["Über", "ÄB", "x\x0by", "tab\tbed", "İstanbul", "ﬁn", "a b", "1", "ZETA", "zeta", "\x1c", "\x85"] + ["".join(rng.choices("abcdEFG", k=4)) for _ in range(80)]
    base = [" ".join(rng.choices(words, k=rng.randrange(1, 300))) for _ in range(40)]
    texts = base + base[:10] + [None, "", " \t\n", "one", "one two", "ONE two", "x " * 20_000]
    for t in base:
        for _ in range(6):
            w = t.split(" ")
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    ids = rng.sample(range(-50, 1000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumns({"fp": F.lit(1), "n": F.lit(2), "key": F.lit(3)})
    df.repartition(5).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = S.op13_simhash(spark, f"file://{tmp_path}").collect()
    prints = {i: by_hand(t) for i, t in zip(ids, texts, strict=True)}
    want = least_reachable(prints)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{prints[i]:016x}", want[i]) for i in ids} and len(got) == len(ids)
    assert len(set(want.values())) < len(ids) - 50


@pytest.mark.parametrize("blocks, small", [(None, 32), (5, 2), (7, 3), (8, 1)])
def test_links_connect_all_that_is_close(spark, blocks, small):
    """Chains, dense clusters and far ones; with small groups everything goes through crowded blocks and points."""
    rng = random.Random(blocks or 1)
    prints = {0, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(60))}
    for _ in range(6):
        p = rng.getrandbits(64)
        for _ in range(40):
            p ^= sum(1 << b for b in set(rng.choices(range(rng.choice([8, 64])), k=rng.randrange(1, 6))))
            prints.add(p)
    rows = [(int(np.array(p, np.uint64).view(np.int64)), 1 + rng.randrange(3)) for p in prints]
    links = S.links(spark.createDataFrame(rows, "fp long, copies long"), blocks=blocks, small=small).collect()
    assert all(bin((r.u ^ r.v) & (1 << 64) - 1).count("1") <= 4 for r in links)
    want = least_reachable({fp: fp & (1 << 64) - 1 for fp, _ in rows})
    up = {fp: fp for fp, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for r in links:
        x, y = sorted((root(r.u), root(r.v)))
        up[y] = x
    assert {i: root(i) for i in up} == want


def test_blocks_follow_the_count():
    assert [S.block_count(n) for n in (0, 3000, 100_000, 10**6, 10**8, 10**10)] == sorted(S.block_count(n) for n in (0, 3000, 100_000, 10**6, 10**8, 10**10))
    for blocks in (5, 6, 9):
        masks = S.block_masks(blocks)
        rng = random.Random(blocks)
        for _ in range(200):
            d = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not d & m for m in masks)


def test_defined_cases(spark):
    """Repeated rows and ids keep their rows, rows without an id have a component, an empty table gives no rows."""
    rows = [(7, "a b c d e"), (7, "a b c d e"), (7, "other words at all here"), (None, "A b c D e"), (None, "nobody else says this")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.id, r.component_id) for r in S.simhash_components(df).collect()), key=str)
    assert got == sorted([(7, 7), (7, 7), (7, 7), (None, 7), (None, None)], key=str)
    assert S.simhash_components(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        S.links(df, distance=3)
