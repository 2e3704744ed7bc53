"""Secret scans: a trigram index narrows each rule to candidate documents, which are then verified."""

from __future__ import annotations

import re
from collections.abc import Mapping
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import saved, table
from gradeloom.llm.spans import labelled, listed, with_matches

#: The base kinds, in their order.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
#: What the method adds.
ADDED = {
    "private_key": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----",
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack": r"xox[abprs]-[0-9A-Za-z-]{10,}",
    "google": r"AIza[0-9A-Za-z_-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
#: The value of an assignment has 8 characters or more.
VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""

#: Most spellings of a run of literals that are followed before the run is cut.
SPELLINGS = 32

Query = list[list[frozenset[str]]]


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(pattern: str) -> Query:
    """What any match must contain: clauses to be met together, each a choice of sets of lower-case trigrams.

    Runs of literals, short choices and optional letters are spelled out; any wider part ends a run. A run
    of which one spelling has no trigram asks for nothing. An empty query means: scan fully.
    """
    clauses: Query = []

    def flush(run: set[str]) -> set[str]:
        wanted = {_trigrams(s) for s in run}
        if frozenset() not in wanted:
            clauses.append(sorted(wanted, key=sorted))
        return {""}

    def spell(parts) -> set[str] | None:
        """All spellings of a part of bounded kind, else None."""
        out = {""}
        for kind, value in parts:
            if kind is op.LITERAL:
                more = {chr(value).lower()}
            elif kind is op.SUBPATTERN:
                more = spell(value[3])
            elif kind is op.BRANCH:
                each = [spell(b) for b in value[1]]
                more = None if None in each else set().union(*each)
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] <= 2:
                one = spell(value[2])
                more = None if one is None else set().union(*({s * k for s in one} for k in range(value[0], value[1] + 1)))
            elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
                more = {chr(v).lower() for _, v in value}
            else:
                more = None
            if more is None or len(out) * len(more) > SPELLINGS:
                return None
            out = {a + b for a in out for b in more}
        return out

    def walk(parts, run: set[str]) -> set[str]:
        for part in parts:
            more = spell([part])
            if more is not None and len(run) * len(more) <= SPELLINGS:
                run = {a + b for a in run for b in more}
            elif part[0] is op.SUBPATTERN:
                run = walk(part[1][3], run)
            else:
                run = flush(run)
                if part[0] in (op.MAX_REPEAT, op.MIN_REPEAT) and part[1][0] > 0:
                    flush(walk(part[1][2], {""}))
        return run

    flush(walk(_parser.parse(pattern), {""}))
    return clauses


def trigram_index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, id) of the given lower-case trigrams: one row for each text that has it."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("(?=(" + "|".join(map(re.escape, trigrams)) + "))"), F.lit(1)))
    return docs.select(F.explode(found).alias("trigram"), F.col(id_col).alias("id"))


def candidates(index: DataFrame, queries: Mapping[str, Query]) -> DataFrame:
    """(id, rules): the rules whose Boolean queries a text's postings satisfy.

    The query terms are few and broadcast; postings are dealt by id, so a trigram that a third of all
    texts share makes no large task. Each list of rules is at most as long as the rule list.
    """
    terms = [(rule, c, a, t, len(alt)) for rule, clauses in queries.items() for c, clause in enumerate(clauses) for a, alt in enumerate(clause) for t in sorted(alt)]
    names = ("rule", "clause", "alt", "trigram", "need")
    rows = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, term, strict=True))) for term in terms))
    terms = index.sparkSession.range(1).select(F.inline(rows))
    need = F.create_map(*(x for rule, clauses in queries.items() for x in (F.lit(rule), F.lit(len(clauses)))))
    met = index.join(F.broadcast(terms), "trigram").groupBy("id", "rule", "clause", "alt", "need").agg(F.count(F.lit(1)).alias("n")).where("n = need")
    met = met.groupBy("id", "rule").agg(F.count_distinct("clause").alias("n")).where(F.col("n") == need[F.col("rule")])
    return met.groupBy("id").agg(F.collect_set("rule").alias("rules"))


def scan(docs: DataFrame, rules: Mapping[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add for each rule its matches: array<struct<start, end, match>>, in code points.

    A rule with mandatory trigrams is only matched against its candidates from the index; a rule without
    any is matched against every text. Null text counts as empty and null ids as one id; candidates of a
    repeated id are candidates for each of its rows; columns named like a rule are replaced, others stay; an
    empty table gives no rows.
    """
    queries = {rule: q for rule, pattern in rules.items() if (q := trigram_query(pattern))}
    trigrams = sorted({t for q in queries.values() for clause in q for alt in clause for t in alt})
    index = trigram_index(docs, trigrams, id_col, text_col)
    found = candidates(index, queries).select(F.col("id").alias("_scan_id"), F.col("rules").alias("_scan_rules"))
    out = docs.drop(*rules).join(found, docs[id_col].eqNullSafe(found["_scan_id"]), "left").drop("_scan_id")
    gates = {rule: F.coalesce(F.array_contains("_scan_rules", rule), F.lit(False)) for rule in queries}
    return with_matches(out, text_col, rules, gates).drop("_scan_rules")


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """All base and added secrets of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scan(docs, BASE | ADDED).drop("text")
    rows = rows.withColumn("assign", F.filter("assign", lambda s: F.length(F.regexp_extract(s["match"], VALUE, 1)) >= 8))
    rows = rows.withColumns({"base": labelled({k: F.col(k) for k in BASE}), "all": labelled({k: F.col(k) for k in [*BASE, *ADDED]})})

    def n(kind: str) -> Column:
        return F.size(kind).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(n, BASE), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))
