"""Operators against brute force on small inputs: nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import bpe, decontamination, fingerprints, lm_scoring, near_dups, pii, quality, secrets, spans, token_files, url_filters
from gradeloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, fingerprint string, rule string, h string"
AL = " \t\n\x0b\x1c\x85\xa0 aAbéßst'1٣.,!?\U0001F600語"


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(AL) for _ in range(rng.randrange(40))) for _ in range(n)] + ["", "x" * 5000, "the cat sat on the mat " * 400]


@pytest.fixture(scope="module")
def docs(spark):
    """Repeated rows and ids, nulls in any column, and extra columns with names that operators use."""
    texts = random_texts(40)
    rows = [(i, t, "f", "r", "h") for i, t in enumerate(texts)] + [(3, texts[3], "f", "r", "h"), (5, "another text with id five", None, None, None), (90, None, None, None, None), (None, "no id here", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_tiktoken(spark, docs, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    tree, ids_of = bpe.coder(path, P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tree.ranks, special_tokens={})
    texts = [*random_texts(3000, 2), None, "a b", " a", "a ", "a  b", "c\u00a0 d \u2003e", "x \u3000 y z"]
    for most in (10**6, 10**6, 50, 50):  # from the second time on from a memo, of late a small one
        ids_of.entries = ids_of.encode.entries = most
        ids, at = ids_of(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == lib.encode_ordinary(t or ""), t
            assert tree.decode(ids[at[i] : at[i + 1]]).tobytes() == (t or "").encode()
    bpe.coder.cache_clear()
    want = Counter((r.doc_id, r.text or "") for r in docs.collect())
    got = bpe.digests(docs, path, P.PATTERN).collect()
    digest = lambda t: (hashlib.sha256(np.array(lib.encode_ordinary(t), "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in got) == Counter({(i, *digest(t)): n for (i, t), n in want.items()})
    back = bpe.decode(bpe.encode(docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in back) == want
    assert bpe.digests(empty, path, P.PATTERN).count() == 0


def test_fingerprints(spark, docs, empty):
    rows = spark.createDataFrame([(1, "A  b\nC"), (2, "a b c "), (3, "ａ b c"), (4, "a bc"), (5, None), (6, ""), (7, "Straße"), (8, "STRASSE")], "doc_id int, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprints.with_fingerprint(rows).collect()}
    assert got[1] == got[2] == got[3] != got[4] and got[5] == got[6] and got[7] == got[8] and len(got[1]) == 32
    every = fingerprints.with_next(docs, hashed=True).collect()
    order = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    nexts = Counter((*a, b[1]) for a, b in zip(order, order[1:] + order[:1], strict=True))
    assert Counter((r.doc_id, r.text, r.next_text) for r in every) == nexts
    assert fingerprints.with_next(empty).count() == 0 and fingerprints.with_fingerprint(empty.drop("fingerprint")).count() == 0


def test_next_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 3)
    rows = spark.range(1000).select((F.col("id") * 7).alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = {r.text: r.next_text for r in fingerprints.with_next(rows).collect()}
    assert got == {str(i): str(i - 1 if i else 999) for i in range(1000)}


def brute_classes(texts):
    sets = [near_dups.shingles(t) for t in texts]
    head = list(range(len(texts)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            near = near_dups.similarity(sets[i], sets[j]) >= 0.8 if len(sets[i][0]) and len(sets[j][0]) else (texts[i] or "") == (texts[j] or "")
            if near:
                a, b = sorted((find(i), find(j)))
                head[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_duplicates(spark, docs, empty):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 200]))]
        for _ in range(rng.randrange(1, 14)):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    texts += ["", None, "!!", "??", "!!", "one", "one", "a b c d e " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.class_id for r in near_dups.near_classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    assert near_dups.near_classes(docs).count() == docs.count()
    assert near_dups.near_classes(empty).count() == 0


def edited(rng, base, n, vocabulary):
    own = list(base)
    for _ in range(n):
        own[rng.randrange(len(own))] = rng.choice(vocabulary)
    return own


def test_one_large_group_loses_no_link(spark):
    """Near copies of one text, of texts cut from it and of edits that some share, all in one group: classes as by brute force."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    other = edited(rng, base, 6, vocabulary)
    bases = [base, other, base[:70], base[40:120], base + base[:60], edited(rng, other, 5, vocabulary), edited(rng, base[:70], 3, vocabulary), ["a", "b", "c"] * 50]
    texts = list(dict.fromkeys(" ".join(edited(rng, b, rng.randrange(9), vocabulary)) for b in bases for _ in range(30)))
    sets = [near_dups.shingles(t) for t in texts]
    name = [near_dups._node(t, s) for t, s in zip(texts, sets, strict=True)]
    groups = spark.createDataFrame([(1, bytearray(k), int(s[1].sum())) for k, s in zip(name, sets, strict=True)], "key long, node binary, weight long")
    feature = spark.createDataFrame([(bytearray(k), bytearray(s[0].tobytes()), bytearray(s[1].astype("<u4").tobytes())) for k, s in zip(name, sets, strict=True)], "node binary, hashes binary, counts binary")
    links = near_dups.near_links(groups, feature)
    got = {bytes(r.node): bytes(r.component) for r in connected_components(links).collect()}
    want: dict = {}
    for i, c in enumerate(brute_classes(texts)):
        want.setdefault(c, set()).add(name[i])
    found: dict = {}
    for k in name:
        found.setdefault(got.get(k, k), set()).add(k)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values())) and max(map(len, want.values())) > 10
    at = dict(zip(name, sets, strict=True))
    assert all(near_dups.similarity(at[bytes(r.u)], at[bytes(r.v)]) >= 0.8 for r in links.collect())


def test_signature_estimates_weighted_similarity():
    a, b = (np.array([1, 2, 3], np.uint64), np.array([5, 3, 1])), (np.array([1, 2, 4], np.uint64), np.array([3, 3, 2]))
    s = near_dups.signatures([a, b], k=4000)
    assert abs((s[0] == s[1]).mean() - near_dups.similarity(a, b)) < 0.04


def test_decontamination(spark, docs, empty, monkeypatch):
    rows = [(1, "a b c d"), (2, None), (3, ""), (1, "a x b c"), (4, "b a"), (None, "A b, c"), (7, " ".join(["w"] * 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(10, "A, b c"), (11, "a b"), (12, ""), (13, None), (14, " ".join(["w"] * 12))], "item_id long, text string")
    want = Counter({(1, 4, (), ()): 1, (2, 0, (), ()): 1, (3, 0, (), ()): 1, (4, 2, (), ()): 1, (None, 3, (0, 1, 2), ("10", "11")): 1, (7, 30, tuple(range(30)), ("14",)): 1, (1, 4, (0, 1, 2), ("10", "11")): 0})
    want[(1, 4, (0, 1, 2), ("10", "11"))] = 1

    def answers(slop=0):
        return Counter((r.id, r.n_words, tuple(sorted(r.hit)), tuple(r.items)) for r in decontamination.occurrences(df, items, slop=slop).collect())

    assert answers() == want
    near = {(r[0], r[3]) for r in answers(1)}
    assert (4, ("11",)) in near and not any("14" in i for k, i in near if k != 7)
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 8)
    assert answers() == want
    assert decontamination.occurrences(empty, items).count() == 0
    none = items.limit(0)
    assert decontamination.occurrences(docs, none).where("size(hit) > 0").count() == 0
    terms = decontamination.build_index(df.where("doc_id = 7")).first()
    assert terms.terms == ["w"] and terms.counts == [30]


PII = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(d := re.sub("[ -]", "", m)) <= 19 and sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(d))) % 10 == 0),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def test_pii_spans(spark, docs, empty):
    rng = random.Random(3)
    parts = ["a@b.com", "a@b", "x_y.z@q-r.st", "_", "@", " ", ".", "1.2.3.4", "256.1.1.1", "001.02.3.0255", "4539 1488 0343 6467", "4539148803436467", "+1 (743) 555-3824", "+49 30 1234567", "-", "5", "12", "é", "\U0001F600", "", "+", "(", "\n", "1.1.1.1.1.1.1.1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(800)] + [None, "", "1." * 3000 + "a@b.c " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.with_base_spans(df).withColumn("b", spans.listed(spans.labelled({k: F.col(k) for k in pii.BASE}))).collect():
        found = sorted((m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(PII) for m in p.finditer(texts[r.doc_id] or "") if ok(m[0]))
        assert r.b == ",".join(f"{k}:{a}:{b}" for a, _, b, k in found), texts[r.doc_id]
    some = spark.createDataFrame([(1, "to a@b.com, 1.2.3.4!"), (2, None), (3, "none")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redact(some, None).collect()} == {1: "to [EMAIL], [IP]!", 2: None, 3: "none"}
    assert pii.train(empty) is None and pii.train(docs) is None
    assert pii.find_pii(docs, None).count() == docs.count()


def test_boosted_trees_choose_candidates(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        n = "".join(rng.choice("0123456789") for _ in range(9))
        rows.append((i, f"call +1 ({n[:3]}) {n[3:6]}-{n[5:9]} now" if i % 2 else f"part {n[:2]} {n[2:4]} {n[4:6]}%x"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    trees = pii.train(df)
    assert trees is not None and trees.threshold is not None
    assert pii.find_pii(df, trees).where("size(added) > 0 AND doc_id % 2 = 0").count() == 0


def test_masked_mails_and_national_phones_are_redacted(spark):
    rng = random.Random(10)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = []
    for i in range(600):
        mine = [f"write to ann.{digits(2)}@mail{digits(1)}.example.com today", f"ring us +1 ({digits(3)}) 555-{digits(4)} today", f"the lot {digits(rng.randrange(7, 13))} went. Then it rained"][i % 3]
        rows.append((i, "it was so. " + mine))
    trees = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    planted = {
        "to john (at) example (dot) com or": "to [PRIVATE] or", "to john[at]example[dot]com or": "to [PRIVATE] or", "me: 555-123-4567 now": "me: [PRIVATE] now",
        "me: (555) 123-4567 now": "me: [PRIVATE] now", "to a@b.com, now": "to [EMAIL], now", "john (at) example (dot) com. Then": "[PRIVATE]. Then",
    }
    kept = ["on 2020-12-05 we", "sum 1.234.567 of", "we met (at) noon. Then we", "lot 5551234567 of", "part 12 34 56 of", "10 @ 2.50 each"]
    df = spark.createDataFrame([(t,) for t in [*planted, *kept]], "text string").withColumn("was", F.col("text"))
    assert {r.was: r.text for r in pii.redact(df, trees).collect()} == planted | {t: t for t in kept}


def test_long_runs_for_every_generator(spark):
    """Runs of 20,000 parts, which would overflow the stack of a matcher that recurses."""
    n = 20_000
    texts = ["a@b" + ".c" * n, "a@b" + " . c" * n, "a (at) b" + " (dot) c" * n, "1 2-" * n, "+1" + " 2" * n, "(" * n + "5" * n, "1." * n, "a@" * n, "x" * n + "@"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.with_candidates(df).select("doc_id", "email", F.size("candidates").alias("n")).collect()}
    assert [(s.start, s.end) for s in got[0].email] == [(0, 3 + 2 * n)] and got[1].n and got[2].n and got[4].n and len(got) == len(texts)


def test_redaction_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([("me@x.org", "write to me@x.org", "a", 1)], "email string, text string, added string, candidates int")
    assert pii.redact(df, None).collect()[0].asDict() == {"email": "me@x.org", "text": "write to [EMAIL]", "added": "a", "candidates": 1}


def test_secrets(spark, docs, empty):
    assert secrets.trigram_query("[0-9a-f]{32,}") == []
    assert secrets.trigram_query("api_?key") == [[frozenset({"api", "pi_", "i_k", "_ke", "key"}), frozenset({"api", "pik", "ike", "key"})]] or len(secrets.trigram_query("api_?key")[0]) == 2
    rng = random.Random(4)
    parts = ["token", "Secret", "api_key", "APIKEY", "=", ":", " ", '"', "abc", "A1b2C3d4", "AKIA", "ABCDEFGH1234", "deadbeef", "0123456789abcdef", "\n", "é", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(800)] + [None, ""]
    df = spark.createDataFrame([*enumerate(texts), (None, "token=abcdefgh1"), (1, "token=abcdefgh2")], "doc_id long, text string")
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in secrets.scan(df, secrets.BASE | secrets.ADDED).collect():
        t = r.text or ""
        assert [(s.start, s.end) for s in r.assign] == [m.span() for m in assign.finditer(t)]
        assert [(s.start, s.end) for s in r.access] == [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        assert [(s.start, s.end) for s in r.hex] == [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        assert len(r.private_key) == t.count("-----BEGIN RSA PRIVATE KEY-----")
    assert secrets.scan(docs, secrets.BASE).count() == docs.count() and secrets.scan(empty, secrets.BASE).count() == 0


def test_lm_scores(spark, docs, empty):
    train = ["abracadabra", "the theme", "é x", ""]
    model = lm_scoring.Ppm(*(x.astype(np.int64) for x in lm_scoring.context_counts(train)))

    def brute(text):
        n = [{}, {}, {}]
        for t in train:
            b = b"\xff\xff" + t.encode() + b"\xff"
            for i in range(2, len(b)):
                for o in range(3):
                    n[o].setdefault(b[i - o : i], Counter())[b[i]] += 1
        b, total = b"\xff\xff" + text.encode() + b"\xff", 0.0
        for i in range(2, len(b)):
            left: set = set()
            for o in (2, 1, 0):
                c = {k: v for k, v in n[o].get(b[i - o : i], {}).items() if k not in left}
                if b[i] in c:
                    total += math.log10(c[b[i]] / (sum(c.values()) + len(c)))
                    break
                if c:
                    total += math.log10(len(c) / (sum(c.values()) + len(c)))
                left |= set(c)
            else:
                total -= math.log10(256 - len(n[0][b""]))
        return total

    for t in ("abra", "the", "zzz", "éa", "", "xéb the q"):
        assert abs(brute(t) - model.scores([t])[0]) < 1e-4
    rows = docs.collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: [*(w.decode() for w in (t or "").encode().lower().split()), None]
    c = Counter(w for r in rows if not held(r.doc_id) for w in split(r.text))
    total = sum(c.values())
    want = Counter((r.doc_id, held(r.doc_id), len(split(r.text)), sum(c[w] > 0 for w in split(r.text)), total, round(sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in split(r.text)), 6)) for r in rows)
    assert Counter((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm_scoring.score(docs).collect()) == want
    assert lm_scoring.score(empty).count() == 0


def test_lm_scores_use_contexts_of_four_bytes(spark, docs):
    def brute(train, texts, order):
        n = Counter()
        followers: dict = {}
        for t in train:
            b = b"\xff" * order + t.encode() + b"\xff"
            for i in range(order, len(b)):
                for o in range(order + 1):
                    followers.setdefault(b[i - o : i], Counter())[b[i]] += 1
        for t in texts:
            b, total = b"\xff" * order + t.encode() + b"\xff", 0.0
            for i in range(order, len(b)):
                left: set = set()
                for o in range(order, -1, -1):
                    c = {k: v for k, v in followers.get(b[i - o : i], {}).items() if k not in left}
                    if b[i] in c:
                        total += math.log10(c[b[i]] / (sum(c.values()) + len(c)))
                        break
                    if c:
                        total += math.log10(len(c) / (sum(c.values()) + len(c)))
                    left |= set(c)
                else:
                    total -= math.log10(256 - len(followers[b""]))
            n[t] = round(total, 2)
        return n

    rows = docs.collect()
    train = [r.text or "" for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    want = brute(train, {r.text or "" for r in rows}, 4)
    got = lm_scoring.score(docs).join(docs.select(F.col("doc_id").alias("id"), "text").distinct(), "id").collect()
    for i, t in {(r.id, r.text or "") for r in got}:
        assert any(abs(r.score - want[t]) < 0.02 for r in got if r.id == i), (i, t)
    # what follows is told only by the fourth byte back
    told = [(i, ("abcd1 zbcd2 " if i % 2 else "zbcd2 abcd1 ") * 5) for i in range(200)]
    df = spark.createDataFrame(told, "doc_id long, text string")
    two, four = (lm_scoring.score(df, order=o).where("held_out").agg(F.sum("score")).first()[0] for o in (2, 4))
    assert four > 0.8 * two


def test_url_filters(spark, empty):
    link = '<link href="http://bad.example.com/en/1" rel="canonical">'
    urls = [("http://x.example.com/en/a", None), ("https://www.example.com/en/a", None), ("http://example.com", None), ("ftp://A.NET/es/?q", None), ("http://notnet/es/", None), (None, None), ("nonsense", "<p>"), ("http://mirror.org/1", link), ("http://mirror2.org/1#x", '<meta http-equiv="refresh" content="0; url=http://mirror.org/1">'), ("https://mirror2.org/1/", None), ("http://free.org/", None), ("http://bad.example.com/en/1", None)]
    df = spark.createDataFrame([(i, u, h, "k") for i, (u, h) in enumerate(urls)], "page_id long, url string, html string, key string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.filter_urls(df).collect()}
    assert got[0] == ("example.com/en/", "block") and got[1] == ("www.example.com/en/", "allow") and got[2] == (None, "allow") and got[3] == ("net/es/", "block")
    assert got[4] == got[5] == got[6] == got[10] == (None, "allow")
    assert got[7] == got[8] == got[9] == (None, "block") and got[11] == ("example.com/en/", "block")
    assert url_filters.filter_urls(df.limit(0)).count() == 0 and {r.key for r in url_filters.filter_urls(df).collect()} == {"k"}
    import duckdb

    con = duckdb.connect()
    con.register("pages", df.toPandas())
    rows = url_filters.filter_urls(df).select("page_id", "url_host", "url_path", "rule", "verdict", "component").collect()
    assert sorted(map(tuple, rows)) == sorted(con.sql(url_filters.op8_sql()).fetchall())


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 3), (4, None), (5, 5)]
    head = {}

    def find(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            head[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in head}


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    ids_of, alphabet = token_files.tokenizer(path, P.PATTERN)
    lib = Tokenizer.from_file(path)
    texts = [*random_texts(2000, 7), "a <|endoftext|> b", "<|endoftext|>", " <|endoftext|>x y"]
    ids, at = ids_of(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    rng = np.random.default_rng(0)
    for n in (1, 63, 64, 65, 3000):
        for x in (rng.integers(0, alphabet, n), np.zeros(n, int), rng.zipf(1.3, n) % alphabet):
            data = token_files.encode_block(x, alphabet)
            assert (token_files.decode_block(data, alphabet) == x).all()
    with pytest.raises(ValueError):
        token_files.decode_block(data[:-2], alphabet)
    bad = bytearray(data)
    bad[-9] ^= 255
    with pytest.raises(ValueError):
        token_files.decode_block(bytes(bad), alphabet)
    out = f"file://{tmp_path}/tokens"
    token_files.write(docs, out, path, P.PATTERN)
    got = sorted(token_files.read(spark, out, alphabet).collect(), key=lambda r: r.start)
    order = sorted(((r.doc_id, r.text or "", r.text is not None) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    at = 0
    for r, (i, t, _) in zip(got, order, strict=True):
        want = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert (r.id, r.start, bytes(r.tokens)) == (i, at, want)
        at += len(want) // 4
    token_files.write(empty, f"{out}-none", path, P.PATTERN)
    assert token_files.read(spark, f"{out}-none", alphabet).count() == 0


def test_small_blocks(spark, docs, monkeypatch):
    path, size = P.path("byte_bpe_50k.json"), token_files.BLOCK_IDS
    out = f"file://{__import__('tempfile').mkdtemp()}/tokens"
    want = None
    for n in (size, 50):
        monkeypatch.setattr(token_files, "BLOCK_IDS", n)
        token_files.write(docs, f"{out}-{n}", path, P.PATTERN)
        got = sorted((r.start, bytes(r.tokens)) for r in token_files.read(spark, f"{out}-{n}", token_files.tokenizer(path, P.PATTERN)[1]).collect())
        want = want or got
        assert got == want
    assert spark.read.parquet(f"{out}-50").count() > 3


def test_blocks_use_what_came_before(spark):
    """Ids that follow from one or two before them cost less than by their own frequencies; evenly random ones hardly more."""
    rng = np.random.default_rng(5)
    n, a = 1 << 18, 256

    def bits(x):
        data = token_files.encode_block(x, 1000)
        assert (token_files.decode_block(data, 1000) == x).all()
        return 8 * len(data) / len(x)

    one, two, picks = rng.integers(0, a, (a, 3)), rng.integers(0, 32, (32, 32, 2)), rng.integers(0, 6, n)
    first, second = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(2, n):
        first[i] = one[first[i - 1], picks[i] % 3]
        second[i] = two[second[i - 1], second[i - 2], picks[i] % 2]
    for x, most in ((first, 0.5), (second, 0.6)):
        share = np.bincount(x) / n
        assert bits(x) < most * -(share[share > 0] * np.log2(share[share > 0])).sum()
    assert bits(rng.integers(0, a, 4 * n)) < 8.6


def test_quality(spark, docs, empty):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        words = [rng.choice(["the", "river", "runs", "to", "sea", "and", "hill"]) for _ in range(30)]
        rows.append((i, " ".join(words) + "." if i % 3 else " ".join(w + rng.choice(["###", "$$$"]) for w in words), "x"))
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(500)] + [(7, None), (None, 1), (9999, 1)], "doc_id long, quality int")
    model = quality.train(df, labels)
    got = {r.id: r.score for r in quality.score(df, model).collect()}
    assert all((got[i] >= 0.3) == (i % 3 > 0) for i in range(600))
    assert quality.keep_good(df, model).count() == 400
    assert quality.score(docs, model).where("score IS NULL OR score < 0 OR score > 1").count() == 0 and quality.score(empty, model).count() == 0
    constant = quality.train(empty, labels)
    assert {r.score for r in quality.score(df, constant).collect()} == {0.5}
