"""Spelling variants against all pairs of words, and the automata by themselves."""

import random
import re
import zlib
from collections import Counter

import pytest

from gradeloom.llm import spelling as S


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def by_hand(counts):
    form, out = {}, set()
    around = {w: [v for v in counts if near(w, v)] for w in counts}
    for w, n in counts.items():
        best = min(around[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n, len(around[w]), form[w], counts.get(form[w]), root))
    return out


def some_words(rng, n):
    letters = "abnéß" if n % 2 else "abcdefghij"
    found = set()
    while len(found) < n:
        w = "".join(rng.choices(letters, k=rng.randrange(5, 10)))
        found.add(w)
        for _ in range(rng.randrange(3)):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            found.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w + c, w[::-1]]))
    return [w for w in found if len(w) >= 5]


@pytest.mark.parametrize("n, dictionary", [(301, 50_000), (400, 40), (251, 3)])
def test_variants_equal_all_pairs(spark, n, dictionary):
    """With small dictionaries, common halves are spread over several of them."""
    rng = random.Random(n)
    counts = {w: int(rng.paretovariate(0.5)) % 3000 + 3 for w in some_words(rng, n)}
    got = S.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), dictionary=dictionary).collect()
    assert len(got) == len(counts)
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == by_hand(counts)


def test_whole_query(spark, tmp_path):
    rng = random.Random(2)
    words = ["Straße", "STRASSE", "naïve", "naive", "Élan", "élan", "x×y÷z", "Ÿmir", "don't", "ab1cde", "_under_score", "ſlong", "Ångström", "ångström"] + [w.title() for w in some_words(rng, 60)]
    texts = [rng.choice([" ", ", ", "\n", "9"]).join(rng.choices(words, k=rng.randrange(1, 120))) for _ in range(90)]
    rows = [*zip(rng.sample(range(-9, 10**9), 90), texts, strict=True), (None, texts[0]), (4, None), (5, ""), (6, texts[1]), (6, texts[1]), (7, "Wörter " * 9000)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS word").repartition(4).write.parquet(f"file://{tmp_path}/documents.parquet")
    counts, slips = Counter(), 0
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run, slips = run[: h % len(run)] + run[h % len(run) + 1 :], slips + 1
            counts[run] += 1
    got = S.op12_spelling(spark, f"file://{tmp_path}").collect()
    assert slips > 5 and {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == by_hand({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})


def test_roots_of_long_chains(spark):
    rows = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("other", "w3")]
    assert {(r.word, r.root) for r in S.roots(spark.createDataFrame(rows, "word string, form string")).collect()} == {(w, "w37") for w, _ in rows}


def test_automata_are_minimal_and_number_words():
    rng = random.Random(7)
    for _ in range(60):
        words = sorted({"".join(rng.choices("abé", k=rng.randrange(1, 7))) for _ in range(rng.randrange(1, 60))})
        a = S.Automaton(words)
        assert [a.number(w) for w in words] == list(range(len(words))) and a.number("zz") is None
        begins = {w[:i] for w in words for i in range(len(w) + 1)}
        assert a.states == len({frozenset(w[len(b) :] for w in words if w.startswith(b)) for b in begins})
        for w in rng.sample(words, min(9, len(words))):
            for exact in range(len(w) + 1):
                assert a.one_error(w, exact) == {(i, v) for i, v in enumerate(words) if near(w, v) and v[:exact] == w[:exact]}


def test_no_words(spark):
    df = spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")
    assert S.variants(S.word_counts(df)).count() == 0 and S.variants(S.word_counts(df.where("false"))).count() == 0
