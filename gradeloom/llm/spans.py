"""Match positions of regular expressions, in code points, with SQL functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Put around matches; where a text has it, another private character takes its place (no rule matches either).
MARK, OTHER = "", ""
SPAN = "struct<start:int,end:int,match:string>"
#: Pieces that one inner fold takes, an even number: keeps the copying of arrays near linear.
BLOCK = 512


def with_matches(df: DataFrame, text_col: str, patterns: Mapping[str, str], gates: Mapping[str, Column] | None = None) -> DataFrame:
    """Add for each name in patterns a column of that name: array<struct<start, end, match>>.

    Matches are leftmost and non-overlapping, as a Java matcher finds them; start and end (exclusive)
    count code points. Where the name's gate is not true the array is empty and the text is not searched.
    Null text has no matches. Names must not be columns of df.
    """
    gates = gates or {}
    safe = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn("_safe", F.when(F.contains(safe, F.lit(MARK)), F.translate(safe, MARK, OTHER)).otherwise(safe))
    for name, pattern in patterns.items():
        marked = F.split(F.regexp_replace("_safe", pattern, f"{MARK}$0{MARK}"), MARK)
        df = df.withColumn(f"_p_{name}", F.when(gates[name], marked) if name in gates else marked)
    df = df.drop("_safe")
    for name in patterns:
        p = f"`_p_{name}`"
        fold = f"""transform(sequence(0, (size({p}) - 1) div {BLOCK}), b -> aggregate(slice({p}, b * {BLOCK} + 1, {BLOCK}),
            named_struct('pos', 0, 'odd', false, 'out', cast(array() as array<{SPAN}>)),
            (a, x) -> named_struct('pos', a.pos + char_length(x), 'odd', not a.odd, 'out',
                if(a.odd, concat(a.out, array(named_struct('start', a.pos, 'end', a.pos + char_length(x), 'match', x))), a.out))))"""
        joined = f"""aggregate({fold}, named_struct('pos', 0, 'out', cast(array() as array<{SPAN}>)),
            (a, b) -> named_struct('pos', a.pos + b.pos, 'out', concat(a.out,
                transform(b.out, s -> named_struct('start', a.pos + s.start, 'end', a.pos + s.end, 'match', s.match))))).out"""
        df = df.withColumn(name, F.expr(f"if(coalesce(size({p}), 0) > 1, {joined}, cast(array() as array<{SPAN}>))"))
    return df.drop(*(f"_p_{name}" for name in patterns))


def labelled(kinds: Mapping[str, Column]) -> Column:
    """All spans as array<struct<start, rank, end, kind>>, by start, then kind as listed."""

    def ranked(rank: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    parts = [ranked(rank, kind, spans) for rank, (kind, spans) in enumerate(kinds.items())]
    return F.array_sort(F.concat(*parts))


def listed(spans: Column) -> Column:
    """kind:start:end of labelled spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
