"""Rounding and durations. All functions take and return Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest whole number, halves upwards (-2.5 gives -2), as DOUBLE arithmetic. Null stays null."""
    return F.floor(x.cast("double") + 0.5)


def cents(x: Column) -> Column:
    """Nearest hundredth, halves upwards, as a double."""
    return half_up(x * 100) / F.lit(100.0)


def percent(part: Column, whole: Column) -> Column:
    """Whole per cent; null where whole is 0."""
    return F.when(whole > 0, half_up(part / whole * 100))


def clock(seconds: Column) -> Column:
    """h:mm:ss from one hour on, else mm:ss; negative counts as 0."""
    s = F.greatest(F.lit(0), half_up(seconds)).cast("long")
    h, m, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(rest))).otherwise(F.concat_ws(":", two(m), two(rest)))


def minutes_text(seconds: Column) -> Column:
    """'N min' below one hour, else 'H h' or 'H h M min'."""
    m = half_up(seconds / 60).cast("long")
    h, rest = F.floor(m / 60).cast("string"), m % 60
    return F.when(m < 60, F.concat(m.cast("string"), F.lit(" min"))).when(rest == 0, F.concat(h, F.lit(" h"))).otherwise(F.concat(h, F.lit(" h "), rest.cast("string"), F.lit(" min")))
