"""Line records from a text column or from text files, by Spark's own operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def split_lines(text: Column) -> Column:
    """Lines ended by CR LF, CR or LF; nothing after the last end."""
    parts = F.split(text, r"\r\n|\r|\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_records(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line, value``: the lines of each text, numbered from 0 inside it."""
    return df.select(key, F.posexplode(split_lines(F.coalesce(F.col(text), F.lit("")))).alias("line", "value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` of every line under a path, from any store, splittable. A byte order mark at a file's start is lost: use ``read_records`` where it counts."""
    return spark.read.text(path)


def split_fields(text: Column, delimiter: str = ",") -> Column:
    """Fields of a record without quotes; an empty record has one."""
    return F.split(text, "\\Q" + delimiter + "\\E", -1)
