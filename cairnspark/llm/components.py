"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014).

Everything stays in DataFrames; each step is staged as a table in the shared folder, so lineage
stays short and a lost executor costs no earlier step. Neighbourhoods are never gathered: a step
takes each node's least neighbour by a pre-aggregated minimum and joins it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm.shared import drop_staged, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: distinct (u, v) with u > v. The same components with edges nearer to a star."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
    return out.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, small: int | None = None) -> DataFrame:
    """edges (a, b) of ids, small at most (see staged); out: (id, root), staged; root the least id, for all nodes that have an edge."""
    now = staged(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", small)
    mark = None
    while True:
        after = staged(_star(_star(now, True), False), "edges", small)
        drop_staged(now)
        new = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = after
        if tuple(new) == mark:
            break
        mark = tuple(new)
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    out = staged(now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots), "roots", small)
    drop_staged(now)
    return out
