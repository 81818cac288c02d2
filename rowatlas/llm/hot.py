"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key from which on it is not shuffled, and keys that are broadcast at most (a few numbers each: 16 MB).
HOT_ROWS, HOT_KEYS = 100, 200_000


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int, left_outer: bool = False) -> DataFrame:
    """``left`` with the row of ``right`` for its key.

    ``right`` has each key once, and in the column ``count`` how many rows of ``left`` have it; ``total`` is no less
    than the sum of those. Keys with many rows are broadcast and meet their rows where they lie: there are at
    most ``total`` over their least number, so at most HOT_KEYS. All other keys are joined by a shuffle, in
    which no key has more than that number of rows. A null key finds nothing.
    """
    many = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = F.broadcast(right.where(F.col(count) > many).withColumn("_hot", F.lit(True)))
    marked = left.join(hot, key, "left")
    cold = marked.where("_hot is null").select(*left.columns).join(right.where(F.col(count) <= many), key, "left" if left_outer else "inner")
    return marked.where("_hot").drop("_hot").unionByName(cold)
