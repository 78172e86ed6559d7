"""Connected components of an edge table by alternating large-star and small-star steps
(Kiveris et al., Connected Components in MapReduce and Beyond, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import scratch_root


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """One star step over (u, v) rows: hang neighbours of each u on the smallest of u and them."""
    # cut first, so that the join shuffles both sides and AQE can split the root of a large component
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).checkpoint()
    met = pairs.join(least, "u")
    if larger_only:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Null ends and self-loops are ignored. No node's neighbours meet in one task beyond what
    Spark splits: minima are combined before the shuffle, the join is one that AQE can split.
    Each round is cut by checkpoint().
    """
    spark = edges.sparkSession
    scratch_root(spark)
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct().checkpoint()
    sign = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = _star(_star(both, True), False).checkpoint()
        s = now.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(u, v) as decimal(38))"))).first()
        if s == sign:
            break
        sign = s
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
