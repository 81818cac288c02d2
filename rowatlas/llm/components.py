"""Connected components of a graph in DataFrames: alternating large-star and small-star.

Each round is two joins of edges with the smallest neighbour of a node, found by
map-side aggregation; no neighbourhood is ever collected, and a node with a third of
all edges meets its edges where they lie (``hot``). Edges are written to the shared
folder each round, which cuts the lineage; rounds end when only stars are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowatlas.llm.hot import join_counted
from rowatlas.llm.scratch import Tables


def _round(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """One large-star and one small-star over edges ``u, v`` with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    # Larger neighbours of a node get the smallest of its neighbours and itself.
    ends = 2 * edges.count()
    large = join_counted(both.where("v > u"), least, "u", "n", ends).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = tables.write(large, f"{name}-large", ends)
    # Smaller neighbours of a node, and the node, get the smallest of them.
    least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    small = join_counted(large, least, "u", "n", large.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node with an edge upwards has one such edge, and none downwards."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0] is not True


def components(edges: DataFrame, tables: Tables, name: str = "cc", rows: int | None = None) -> DataFrame:
    """``node, root`` for every node with an edge other than to itself; the root is the smallest node.

    ``edges`` has columns ``u, v`` of one orderable type without nulls; ``rows`` is a bound of their number, if one is known.
    """
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = tables.write(down, name, rows)
    for _ in range(60):
        if _stars(now):
            break
        now = tables.write(_round(now, tables, name), name, 3 * now.count())  # two rows for an edge at most, and one for a node
        tables.drop(f"{name}-large")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
