"""The row contract: a contiguous zero-based ``row`` in source order, at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with a contiguous zero-based ``name`` in the given order; rows equal in it are ordered by their other columns.

    For narrow frames: keys, and what is needed beside them. Rows are dealt by sampled ranges and sorted inside them:
    the one shuffle. A row's number is its place in its range plus the count of all rows in earlier ranges. No
    task sees more than one range. The counts and the numbers read one and the same exchange: both
    need all columns, since all are part of the order, and ranges of a fixed number are never merged by adaptive execution.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.exchange.reuse", "true").lower() != "true":
        raise ValueError("numbering needs spark.sql.exchange.reuse")
    whole = [*order, *(F.col(c) for c in df.columns)]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # monotonically_increasing_id is the partition in the upper bits, the place in it in the lower 33.
    ranged = df.repartitionByRange(ranges, *whole).sortWithinPartitions(*whole).withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(part.alias("_part")).agg((F.max(place) + 1).alias("n"))
    # One row per range: the window and the broadcast are bounded by their number.
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return ranged.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + place).drop("_id", "_part", "_before")


def with_row(df: DataFrame, *keys: str) -> DataFrame:
    """Rows numbered in the order of key columns that name the source order. Wide tables number their keys alone: ``places``."""
    return ranked(df, [F.col(k).asc_nulls_first() for k in keys], "row")


def places(df: DataFrame, *keys: str) -> DataFrame:
    """``keys, row``: the places of a table's rows, from its keys alone."""
    return with_row(df.select(*keys), *keys)


def at(df: DataFrame, window: DataFrame, *keys: str) -> DataFrame:
    """Records of a table at the places of a window (128 rows at most), which is the broadcast side of a scan. Keys name one row each."""
    return df.join(F.broadcast(window), list(keys))


def width(fields: Column) -> Column:
    """Aggregate: columns of a document, the most fields of any record, 64 at most."""
    return F.least(F.coalesce(F.max(F.size(fields)), F.lit(0)), F.lit(64))
