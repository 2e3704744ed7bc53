"""Connected components of a link table, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import saved


def _settled(links: DataFrame) -> bool:
    """Whether every u has one v, which is nobody's u: then each v is the smallest node of its component."""
    ends = links.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def connected_components(links: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """node, component: the smallest node that its links reach.

    Alternates large-star and small-star steps until all links are stars. A hub with very many
    neighbours costs one partial minimum per task and a join that adaptive execution can split; no
    neighbour list is ever gathered. Each step is a table in the shared folder, so lost executors cost
    one step at most. Null ends and self links are ignored; nodes without a link are not returned.
    """
    a, b = F.col(left), F.col(right)
    e = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = saved(e, "links")
    while not _settled(e):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = saved(small.where("u != v").distinct(), "links")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
