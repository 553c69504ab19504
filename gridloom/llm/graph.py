"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a group-by (with map-side combine) and a join on the same key, so no component is ever
collected in one task. Each round is written to shared scratch space, which also cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import saved
from gridloom.plans.scratch import dropped


def _with_least(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    # Every edge has v < u here; the edge (u, m) itself stays, other neighbours move to m.
    linked = _with_least(edges)
    return linked.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).union(linked.groupBy("u").agg(F.min("m").alias("v")))


def _summary(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """`edges (u long, v long)` to `(node, root)`: the smallest node of each component.

    Self-loops and repeated edges have no effect; nodes without another node are absent; an empty table
    gives an empty table. The number of rounds grows with the logarithm of a component's size.
    """
    now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    was = _summary(now)
    for _ in range(most_rounds):
        if not was[0]:
            break
        before, now = now, saved(_small_star(_large_star(now).where("u <> v").distinct()).where("u <> v").distinct())
        dropped(before)
        before, was = was, _summary(now)
        if before == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
