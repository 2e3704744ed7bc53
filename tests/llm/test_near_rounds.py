"""The rounds of near-duplicates write few tables: each costs a step whatever its size, and check_h deals all of them over 211 tasks."""

import random

from gradeloom.llm import components, near_dups


def _texts():
    """Eighty near copies of one text, of which some have drifted apart, ten pairs and ten texts of their own."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]

    def edit(words, n):
        own = list(words)
        for _ in range(n):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        return own

    base = [rng.choice(vocabulary) for _ in range(200)]
    alone = [[rng.choice(vocabulary) for _ in range(120)] for _ in range(20)]
    return [" ".join(w) for w in [*(edit(base, rng.randrange(9)) for _ in range(80)), *alone, *(edit(w, 1) for w in alone[:10])]]


def test_components_are_carried_on_and_few_tables_are_written(spark, monkeypatch):
    texts, tables, calls = _texts(), [], []
    keep, found = near_dups.saved, near_dups.connected_components
    for module in (near_dups, components):
        monkeypatch.setattr(module, "saved", lambda df, name: tables.append(name) or keep(df, name))
    monkeypatch.setattr(near_dups, "connected_components", lambda links: calls.append(1) or found(links))
    got = {r.id: r.class_id for r in near_dups.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [near_dups.shingles(t) for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if want[i] != want[j] and near_dups.similarity(sets[i], sets[j]) >= 0.8:
                low, high = sorted((want[i], want[j]))
                want = [low if c == high else c for c in want]
    assert got == dict(enumerate(want))
    rounds = tables.count("near_told")
    assert rounds > 1 and not {"near_heads", "near_leaders", "near_links"} & set(tables)
    assert len(calls) <= rounds - 1
    assert len(tables) - tables.count("links") <= 4 + 3 * rounds + 1
