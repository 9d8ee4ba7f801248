"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsheet.session import materialize


def _state(links: DataFrame) -> tuple:
    """Count and order-free digest: equal before and after a round when nothing moved."""
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(links.agg(F.count(F.lit(1)), digest).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are hung on its smallest neighbour (or itself)."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("low"))
    lowest = lowest.withColumn("low", F.least("u", "low"))
    hung = both.where("v > u").join(lowest, "u")
    return hung.select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are hung on the smallest of them."""
    lowest = links.groupBy("u").agg(F.min("v").alias("low"))
    moved = links.join(lowest, "u").where("v > low")
    moved = moved.select(F.col("v").alias("u"), F.col("low").alias("v"))
    return lowest.withColumnRenamed("low", "v").union(moved).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(u, v)``; the root is the smallest node.

    ``links`` holds comparable values without nulls; self links are ignored. A round is two
    shuffled joins; its result is a stored table, so the plan never grows and a lost executor
    costs one round at most. The number of rounds grows with the logarithm of the largest
    component's diameter. A hub is a hot key of the joins, which adaptive skew joins split.
    """
    links = links.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    links = materialize(links.distinct())
    before = _state(links)
    while before[0]:
        links = materialize(_small_star(_large_star(links)))
        after = _state(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
