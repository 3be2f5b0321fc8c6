"""Connected components over an edge table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, written: Callable[[DataFrame], DataFrame], src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge to another node; root is the smallest node of the component.

    Alternating large-star and small-star steps on the edge table: each step is a min per node and one join, so no
    neighbourhood is ever gathered in one task, and a hub's edges can be split by adaptive skew handling. `written`
    cuts the lineage after each round (a table in a folder all executors share). Edges with a null end and self loops
    are ignored; repeated edges count once; no edges give no rows.
    """
    u, v = F.col(src).cast("long"), F.col(dst).cast("long")
    e = edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    e = written(e)
    seen = None
    for _ in range(max_rounds):
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_if(F.col("v") > F.col("u"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = small.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        e = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
