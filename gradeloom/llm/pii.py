"""Personal data: base rules, and candidates that boosted trees select by format and context.

Everything runs as DataFrame and SQL functions: matching, features, the trees (as nested conditions) and
the thresholds. Only training reads a bounded sample, with Spark's own gradient-boosted trees.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import saved, table
from gradeloom.llm.spans import labelled, listed, with_matches

#: Base kinds in their order. Runs are matched possessively from their first character, or from where the
#: last match ended: the same matches as without, in time linear in the text.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators; their spans may overlap each other and the base spans.
GENERATORS = {
    "mail_like": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "mail_tight": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?:(?: ?(?:\(dot\)|\[dot\]) ?|\.)[A-Za-z0-9-]++)++",
    "number_like": r"[+(]?[0-9](?:[0-9() ./-]{5,38}[0-9])",
}
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
CUES = r"(?i)(?:tel|phone|call|fax|mobile|cell|card|account|acct|ssn|iban|mail|contact|address|ip)\W{0,3}$"
FEATURES = ("digits", "others", "groups", "first_group", "plus", "parens", "dots", "dashes", "spaces", "luhn", "ip_parts", "at", "cue", "glued_left", "glued_right", "letters", "last_group", "masked", "loose_dots")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    right = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(right, i + 1, F.lit(1)).cast("int") * (F.lit(1) + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value), F.lit(0), lambda a, d: a + d) % 10 == 0


def only_digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def valid(kind: str, match: Column) -> Column:
    """The base rule's test of a match."""
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    n = F.length(only_digits(match))
    if kind == "card":
        return n.between(14, 19) & luhn(only_digits(match))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def with_base_spans(docs: DataFrame, text_col: str = "text", more: Mapping[str, str] | None = None) -> DataFrame:
    """Add a column of spans for each base kind, and for each pattern of more without a test."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    at, digit = F.contains(text, F.lit("@")), text.rlike("[0-9]")
    masked = F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]"))
    gates = {
        "email": at, "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+")),
        "mail_like": at | masked, "mail_tight": at | masked, "number_like": digit,
    }
    patterns = BASE | dict(more or {})
    out = with_matches(docs, text_col, patterns, {k: g for k, g in gates.items() if k in patterns})
    return out.withColumns({k: _kept(k) for k in BASE})


def _kept(kind: str) -> Column:
    return F.filter(kind, lambda s: valid(kind, s["match"]))


def _features(text: Column, s: Column) -> Column:
    """Format and context of a candidate span, as doubles."""
    m = s["match"]
    before = F.substring(text, F.greatest(s["start"] - 19, F.lit(1)), F.least(s["start"], F.lit(20)))
    digits = only_digits(m)

    def count(pattern: str) -> Column:
        return F.regexp_count(m, F.lit(pattern))

    each = {
        "digits": F.length(digits), "others": F.length(m) - F.length(digits), "groups": count("[0-9]+"),
        "first_group": F.length(F.regexp_extract(m, "[0-9]+", 0)), "plus": m.startswith("+"), "parens": count(r"\("), "dots": count(r"\."),
        "dashes": count("-"), "spaces": count(" "), "luhn": F.length(digits).between(14, 19) & luhn(digits), "ip_parts": m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
        "at": F.contains(m, F.lit("@")), "cue": before.rlike(CUES), "glued_left": before.rlike("[A-Za-z0-9_]$"),
        "glued_right": F.substring(text, s["end"] + 1, F.lit(1)).rlike("[A-Za-z0-9_%]"),
        "letters": count("[A-Za-z]"), "last_group": F.length(F.regexp_extract(m, "([0-9]+)[^0-9]*$", 1)), "masked": count(r"[(\[](?:at|dot)[)\]]"),
        "loose_dots": count(r"(?<! )\. "),
    }
    return F.struct(*(each[f].cast("int").cast("double").alias(f) for f in FEATURES))


def _overlaps(s: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (s["start"] < b["end"]) & (s["end"] > b["start"]))


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Base spans as in with_base_spans, and candidates: array<struct<start, end, match, x, base>>.

    x holds the features; base tells whether a base span is overlapped.
    """
    out = with_base_spans(docs, text_col, GENERATORS)
    out = out.withColumn("_base", F.concat(*BASE))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def described(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), _features(text, s).alias("x"), _overlaps(s, F.col("_base")).alias("base"))

    proposed = F.concat(*GENERATORS)
    empty = F.filter(F.transform(proposed, described), lambda s: F.lit(False))
    described_all = F.when(F.size(proposed) > 0, F.transform(proposed, described)).otherwise(empty)
    return out.withColumn("candidates", described_all).drop("_base", *GENERATORS)


@dataclass(frozen=True)
class Trees:
    """Boosted trees as SQL: margin is an expression over a struct named x; threshold is on the probability."""

    margin: str
    threshold: float | None

    def probability(self, x: str) -> str:
        return f"1 / (1 + exp(-2 * ({self.margin.replace('x.', x + '.')})))"


def _as_sql(lines: list[str]) -> str:
    """A tree of Spark's debug text as nested conditions; takes its lines from the front."""
    line = lines.pop(0).strip()
    if m := re.fullmatch(r"Predict: (\S+)", line):
        return f"({float(m[1])!r}D)"
    m = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
    low = _as_sql(lines)
    lines.pop(0)  # Else
    return f"IF(x.{FEATURES[int(m[1])]} <= {float(m[2])!r}D, {low}, {_as_sql(lines)})"


def _examples(sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, start, end, label: spans with their surroundings, written in ways that no base rule matches.

    Personal data are the mails and phones of the base rules, masked or without the country's number. The
    rest are dates, amounts and tables made of the digits of the same documents, prose around an "at", and
    masked mails that run on into the next sentence.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = with_base_spans(sample, text_col, {"number_like": GENERATORS["number_like"]})

    def around(spans: str, written) -> Column:
        def each(s: Column) -> Column:
            left, right = F.substring(text, F.greatest(s["start"] - 19, F.lit(1)), F.least(s["start"], F.lit(20))), F.substring(text, s["end"] + 1, F.lit(20))
            return F.transform(F.array(*written(s["match"])), lambda v: F.struct(left.alias("left"), v.alias("own"), right.alias("right")))

        return F.flatten(F.transform(spans, each))

    def mails(m: Column) -> list[Column]:
        user, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)

        def dots(d: str) -> Column:
            return F.replace(host, F.lit("."), F.lit(d))

        ways = [(" (at) ", dots(" (dot) ")), ("[at]", dots("[dot]")), ("(at)", host), (" [at] ", host), (" @ ", host), (" (at) ", dots(" . "))]
        return [F.concat(user, F.lit(at), h) for at, h in ways]

    def run_on(m: Column) -> list[Column]:
        return [F.concat(mail, F.lit(". The")) for mail in mails(m)]

    def written_as(d: Column, form: str) -> Column:
        """The digits of d put for the runs of 9 in form."""
        out, at = [], 1
        for part in re.findall("9+|[^9]+", form):
            out.append(F.substring(d, at, len(part)) if part[0] == "9" else F.lit(part))
            at += len(part) * (part[0] == "9")
        return F.concat(*out)

    def phones(m: Column) -> list[Column]:
        return [written_as(F.right(only_digits(m), F.lit(10)), form) for form in ("999-999-9999", "(999) 999-9999", "999 999 9999", "999.999.9999")]

    def others(m: Column) -> list[Column]:
        d = F.repeat(only_digits(m), F.lit(3))
        forms = ("9999-99-99", "99.99.9999", "99/99/9999", "9.999.999", "999.999.999", "99 99 99 99", "9999 99 9999", "9999 9999", "999-9-99-999999-9", "9999-9999-9999", "99 @ 9.99")
        return [written_as(d, form) for form in forms]

    words = F.regexp_extract(text, r"([A-Za-z]+) ([A-Za-z]+\. [A-Za-z]+)", 1), F.regexp_extract(text, r"([A-Za-z]+) ([A-Za-z]+\. [A-Za-z]+)", 2)
    prose = F.transform(F.array(*(F.concat(words[0], F.lit(at), words[1]) for at in (" (at) ", " [at] ", " @ "))), lambda v: F.struct(F.lit("").alias("left"), v.alias("own"), F.lit("").alias("right")))
    kinds = {1.0: [around("email", mails), around("phone", phones)], 0.0: [around("number_like", others), around("email", run_on), F.when(words[0] != "", prose).otherwise(F.filter(prose, lambda v: F.lit(False)))]}
    labelled_arrays = [F.transform(F.concat(*each), lambda e: F.struct(e["left"].alias("left"), e["own"].alias("own"), e["right"].alias("right"), F.lit(label).alias("label"))) for label, each in kinds.items()]
    made = rows.select(F.col(id_col).alias("id"), F.explode(F.concat(*labelled_arrays)).alias("e"))
    start = F.char_length("e.left")
    return made.select("id", F.concat("e.left", "e.own", "e.right").alias("text"), start.alias("start"), (start + F.char_length("e.own")).alias("end"), "e.label")


def sampled(docs: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(id, text): the rows of least id hash, then least text hash, `rows` at most; of equal rows one."""
    hashed = docs.select(id_col, text_col, F.xxhash64(id_col).alias("_by_id"), F.xxhash64(text_col).alias("_by_text"))
    chosen = hashed.select("_by_id", "_by_text").orderBy("_by_id", "_by_text").limit(rows).distinct()
    return hashed.join(F.broadcast(chosen), ["_by_id", "_by_text"], "left_semi").dropDuplicates(["_by_id", "_by_text"]).select(id_col, text_col)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000, precision: float = 0.98) -> Trees | None:
    """Fit trees to tell candidates that are personal data from the rest.

    Personal data are base spans rewritten so that no base rule matches them (masked mails, national phones);
    the rest are the candidates that touch no base span, and other things written alike. Candidates that touch
    a base span are not for the trees to decide and teach nothing. Training takes sample_rows rows at most, those
    of least id hash (see sampled), whatever ids repeat; the candidates of a quarter of the ids are held out to calibrate: the threshold is the lowest
    score above which at least this share of them is personal data, also within each twentieth. None where the sample has only one class, as that of an empty table.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    sample = saved(sampled(docs, id_col, text_col, sample_rows), "pii_texts")
    found = with_candidates(sample, text_col).select(F.col(id_col).alias("id"), F.explode("candidates").alias("c"), F.lit(0.0).alias("label"))
    made = with_candidates(saved(_examples(sample, id_col, text_col), "pii_examples")).select("id", "start", "end", F.explode("candidates").alias("c"), "label")
    made = made.where((F.col("c.start") == F.col("start")) & (F.col("c.end") == F.col("end"))).select("id", "c", "label")
    rows = saved(found, "pii_found").unionByName(saved(made, "pii_made")).where("NOT c.base").select("id", "c.x.*", "label")
    rows = rows.withColumn("held", F.pmod(F.xxhash64("id"), F.lit(4)) == 0)
    rows = saved(rows.repartition(4, "id"), "pii_sample")
    counts = {r["label"]: r["n"] for r in rows.where("not held").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    model = GBTClassifier(maxIter=10, maxDepth=3, stepSize=0.3, seed=1).fit(data.where("not held").select("features", "label"))
    parts = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        lines = [x for x in tree.toDebugString.splitlines() if re.match(r"\s+(If|Else|Predict)", x)]
        parts.append(f"{weight!r}D * {_as_sql(lines)}")
    trees = Trees(" + ".join(parts), None)
    named = ", ".join(f"'{f}', {f}" for f in FEATURES)
    scored = rows.where("held").selectExpr("label", f"named_struct({named}) AS x").selectExpr("label", f"cast(floor(20 * {trees.probability('x')}) AS int) AS bin")
    bins = scored.groupBy("bin").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("bin")).collect()  # 21 rows at most
    good = n = 0
    threshold = None
    for b in bins:
        good, n = good + b["good"], n + b["n"]
        if good < precision * n or b["good"] < precision * b["n"]:
            break
        threshold = b["bin"] / 20
    return Trees(trees.margin, threshold)


def find_pii(docs: DataFrame, trees: Trees | None, text_col: str = "text") -> DataFrame:
    """Add base spans (email, ip, card, phone) and added: array<struct<start, end, match>>.

    added holds candidates that touch no base span and whose probability reaches the threshold. Null text
    counts as empty; repeated rows keep their rows; other columns stay, but for those of the names above,
    which are replaced; an empty table gives no rows. No row looks at another, so there is no shuffle, and
    patterns run in time linear in the text without recursion, whatever its length.
    """
    if trees is None or trees.threshold is None:
        return with_base_spans(docs, text_col).withColumn("added", F.expr("cast(array() as array<struct<start:int,end:int>>)"))
    out = with_candidates(docs, text_col)
    picked = f"filter(candidates, c -> not c.base and {trees.probability('c.x')} >= {trees.threshold})"
    return out.withColumn("added", F.expr(f"array_distinct(transform({picked}, c -> named_struct('start', c.start, 'end', c.end)))")).drop("candidates")


def redact(docs: DataFrame, trees: Trees | None, text_col: str = "text") -> DataFrame:
    """The rows with every span of personal data replaced by its kind in brackets; overlapping spans as one.

    Null texts stay null and empty ones empty; other columns stay as they are, whatever their names; repeated
    rows keep their rows; texts of any length are taken whole; an empty table gives no rows.
    """
    columns = {f"_{i}_": c for i, c in enumerate(docs.columns)}
    out = docs.toDF(*columns)  # so that no column bears the name of a kind
    text_col = next(own for own, c in columns.items() if c == text_col)
    out = find_pii(out, trees, text_col)
    out = out.withColumn("_spans", labelled({k: F.col(k) for k in [*BASE, "added"]}))
    merged = F.expr("""aggregate(_spans, cast(array() as array<struct<start:int,end:int,kind:string>>), (a, s) ->
        if(size(a) > 0 and element_at(a, -1).end > s.start,
           concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end), 'kind', element_at(a, -1).kind))),
           concat(a, array(named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))))""")
    out = out.withColumn("_spans", merged)
    parts = f"""transform(_spans, (s, i) -> concat(substring(`{text_col}`, 1 + if(i = 0, 0, get(_spans, i - 1).end), s.start - if(i = 0, 0, get(_spans, i - 1).end)), '[', upper(if(s.kind = 'added', 'private', s.kind)), ']'))"""
    new = F.expr(f"if(size(_spans) > 0, concat(array_join({parts}, ''), substring(`{text_col}`, element_at(_spans, -1).end + 1)), `{text_col}`)")
    return out.withColumn(text_col, new).select(*(F.col(own).alias(c) for own, c in columns.items()))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """All base and added personal data of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = find_pii(docs, train(docs)).drop("text")
    rows = rows.withColumns({"base": labelled({k: F.col(k) for k in BASE}), "all": labelled({k: F.col(k) for k in [*BASE, "added"]})})

    def n(kind: str) -> Column:
        return F.size(kind).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(n, BASE), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))
