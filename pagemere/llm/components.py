"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on the node, so a node's neighbours never meet in one task: the
minimum is aggregated before the shuffle and the join splits skewed nodes.  Every step is written to the
shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def _join_low(rows: DataFrame, low: DataFrame) -> DataFrame:
    """Joins on the node; the key's bits are turned so that both sides are dealt anew and a hot node's rows can be split."""
    return rows.join(low.select(F.bitwise_not("u").alias("k"), "m"), F.bitwise_not("u") == F.col("k")).drop("k")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is joined to the smallest of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _join_low(both.filter("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u itself, is joined to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = _join_low(down, low)
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """``edges(u, v)`` of longs to ``(u, v)`` where v is the smallest node reachable from u, for each u that isn't it.

    Self-links, repeated edges and edges with a null end are ignored; other columns are not read; an empty table
    gives an empty result.
    """
    now, first = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v"), True
    while True:
        step = tables.write(_small_star(_large_star(now)), "star")
        if not first:
            tables.drop(now)
        now, first = step, False
        # a forest of stars is done: no leaf has two centres, and no centre is a leaf
        sides = now.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(now.select("v", F.lit(0), F.lit(1)))
        nodes = sides.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
        if nodes.filter("leaf > 1 or (leaf > 0 and centre > 0)").isEmpty():
            return now
