"""Whole registered queries on a small folder, row by row against plain Python."""

import hashlib
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import fingerprints, pii, secrets
from tests.llm.test_llm_operators import PII

PARTS = [
    "a@b.com", "a@b", "_", " ", " ", ".", "1.2.3.4", "256.1.1.1", "4539 1488 0343 6467", "4539148803436467", "+1 (743) 555-3824", "-", "12", "é", "\U0001F600", "(", "\n", "token=abcdefgh", "secret: 'x'", "API_KEY = \"A1b2C3d4\"",
    "AKIAABCDEFGH1234", "AKIA12", "0123456789abcdef0123456789abcdef", "deadbeef", "Straße", "STRASSE", "the cat", "The  Cat", "ﬁ", "fi", " ",
]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)).encode()).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(20))) for _ in range(150)]
    texts += [None, "", "", texts[3], texts[3].upper(), texts[4] + " ", "ab", "x" * 9000 + "a@b.com " * 50]
    ids = [3 * i + 1 for i in range(len(texts))]
    rng.shuffle(ids)
    out = f"file://{tmp_path_factory.mktemp('small')}"
    spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3).write.parquet(f"{out}/documents.parquet")
    return out, dict(zip(ids, texts, strict=True))


def test_op5_rows(spark, folder):
    out, texts = folder
    got = {r.doc_id: r for r in pii.op5_pii(spark, out).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        base = [(m.start(), rank, m.end(), kind) for rank, (kind, pattern, ok) in enumerate(PII) for m in pattern.finditer(text or "") if ok(m[0])]
        n = Counter(b[3] for b in base)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in ("email", "ip", "card", "phone")) and r.base_sha256 == digest(base)
        assert {f"{k}:{a}:{b}" for a, _, b, k in base} <= set(r.spans.split(",")) | {""}


def test_op6_rows(spark, folder):
    out, texts = folder
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    rules = [("assign", assign, lambda m: len(m[1]) >= 8), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]
    got = {r.doc_id: r for r in secrets.op6_secrets(spark, out).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        base = [(m.start(), rank, m.end(), kind) for rank, (kind, pattern, ok) in enumerate(rules) for m in pattern.finditer(text or "") if ok(m)]
        n = Counter(b[3] for b in base)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (n["assign"], n["access"], n["hex"]) and got[i].base_sha256 == digest(base)
        assert {f"{k}:{a}:{b}" for a, _, b, k in base} <= set(got[i].spans.split(",")) | {""}


def canonical(text):
    return " ".join(unicodedata.normalize("NFKC", (text or "").casefold()).split())


@pytest.mark.parametrize("narrow", [False, True])
def test_op2_rows(spark, folder, monkeypatch, narrow):
    """With a hash of 4 bits, texts of one bucket must still be told apart by their bytes."""
    out, texts = folder
    if narrow:
        monkeypatch.setattr(fingerprints, "wide_hash", lambda c: F.struct(F.pmod(F.xxhash64(F.lit(1), c), F.lit(16)).alias("a"), F.lit(0).cast("long").alias("b")))
    got = {r.doc_id: r for r in fingerprints.op2_fingerprints(spark, out).collect()}
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    assert set(got) == set(texts)
    for i in order:
        own, other = texts[i] or "", texts[after[i]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(canonical(own) == canonical(edited)), float(canonical(own) == canonical(other)))
        assert (r.fingerprint == r.edited_fingerprint) == (canonical(own) == canonical(edited)) or narrow
    by_text, by_print = {canonical(texts[i]): got[i].fingerprint for i in order}, {got[i].fingerprint: canonical(texts[i]) for i in order}
    assert all(by_text[canonical(texts[i])] == got[i].fingerprint and by_print[got[i].fingerprint] == canonical(texts[i]) for i in order)
