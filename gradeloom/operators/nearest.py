"""As-of joins on a position: for each row the nearest one at or left of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_left(left: DataFrame, right: DataFrame, by: list[str], at: Column, x: Column, value: Column, tie: Column | None = None) -> DataFrame:
    """The rows of left with nearest: the value of the right row of equal `by` columns whose x is greatest, but not above `at`.

    at is a column of left, x, value and tie of right. Of several rows at that x the one with the greatest tie
    counts (by default the greatest value). Both sides are put in one order and looked through once, so no pair
    is ever made. Rows of left without any right row to their left, or without a position, have null;
    so have rows with a null in `by`; right rows without a position are no one's nearest.
    """
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    rows = left.select(*by, at.alias("_x"), F.lit(1).alias("_side"), F.struct(*(F.col(c) for c in left.columns)).alias("_row"))
    marks = right.where(x.isNotNull() & known).select(*by, x.alias("_x"), F.lit(0).alias("_side"), F.struct(value.alias("v")).alias("_value"), (value if tie is None else tie).alias("_tie"))
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_first("_x"), "_side", F.asc_nulls_first("_tie")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_value", F.last("_value", ignorenulls=True).over(order))
    return both.where("_side = 1").select("_row.*", F.col("_value.v").alias("nearest"))
