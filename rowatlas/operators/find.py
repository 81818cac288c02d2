"""Literal search over whole records: every hit, overlapping ones too, by byte position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowatlas.functions.arrays import sums_before
from rowatlas.functions.text import ascii_lower
from rowatlas.operators.rows import ranked

PAGE = 256
HEADER_BYTES, HIT_BYTES = 48, 24


def _both(text: Column, needle: str, case_sensitive: bool) -> tuple[Column, Column]:
    if not needle:
        raise ValueError("the needle is empty")
    return (text, F.lit(needle)) if case_sensitive else (ascii_lower(text), ascii_lower(F.lit(needle)))


def matching(df: DataFrame, text: Column, needle: str, case_sensitive: bool = True) -> DataFrame:
    """Records with a hit. ASCII letters fold if case does not count; others never do."""
    hay, sought = _both(text, needle, case_sensitive)
    return df.where(F.contains(hay, sought))


def _ahead(sought: Column) -> Column:
    """A pattern that matches the empty place in front of each occurrence, overlapping ones too."""
    return F.concat(F.lit("(?=\\Q"), F.replace(sought, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))


def hit_count(text: Column, needle: str, case_sensitive: bool = True) -> Column:
    hay, sought = _both(text, needle, case_sensitive)
    return F.regexp_count(hay, _ahead(sought))


def hits(df: DataFrame, text: Column, needle: str, case_sensitive: bool = True, keys: tuple[str, ...] = ("row",)) -> DataFrame:
    """``keys``, ``start, end``: byte positions in the record, every overlapping hit.

    Records without a hit go first, in the scan. Others are split in front of each occurrence, so a hit
    starts where the pieces before it end: time in proportion to the text and its hits.
    """
    hay, sought = _both(text, needle, case_sensitive)
    size = len(needle.encode())
    cut = df.select(*keys, hay.alias("_hay")).where(F.contains(F.col("_hay"), sought))
    starts = sums_before(F.transform(F.split(F.col("_hay"), _ahead(sought), -1), lambda p: F.octet_length(p).cast("long")))
    # The first piece is a hit only if the record starts with one.
    first = F.when(F.startswith(F.col("_hay"), sought), 1).otherwise(2)
    found = cut.select(*keys, starts.alias("s"), first.alias("f")).select(*keys, F.explode(F.slice("s", F.col("f"), F.size("s"))).alias("start"))
    return found.select(*keys, "start", (F.col("start") + size).alias("end"))


def first_hits(df: DataFrame, text: Column, needle: str, count: int, case_sensitive: bool = True, keys: tuple[str, ...] = ("row",)) -> DataFrame:
    """The first hits in the order of ``keys``, on demand: no record is numbered and no other hit is placed.

    The first ``count`` hits lie in the first ``count`` records that match, which are a top-k of the scan.
    """
    near = matching(df, text, needle, case_sensitive).orderBy(*keys).limit(count)
    return hits(near, text, needle, case_sensitive, keys).orderBy(*keys, "start").limit(count)


def search_counts(df: DataFrame, text: Column, needle: str, case_sensitive: bool = True) -> DataFrame:
    """One row: records examined, records with a hit, and hits."""
    found = hit_count(text, needle, case_sensitive)
    return df.agg(F.count("*").alias("examined"), F.count(F.when(found > 0, 1)).alias("matching"), F.coalesce(F.sum(found), F.lit(0)).cast("long").alias("hits"))


def numbered(found: DataFrame) -> DataFrame:
    """Hits with their ordinal ``hit`` in document order."""
    return ranked(found, [F.col("row").asc(), F.col("start").asc()], "hit")


def page(ordered: DataFrame, first: int, capacity: int = PAGE) -> DataFrame:
    """The aligned page that holds hit ``first``."""
    at = first - first % capacity
    return ordered.where(F.col("hit").between(at, at + capacity - 1))


def hit_at(ordered: DataFrame, hit: int) -> DataFrame:
    return ordered.where(F.col("hit") == hit)


def step(ordered: DataFrame, now: int | None, forward: bool = True) -> DataFrame:
    """The next or previous hit; from none, the first or last. There is no way round the end."""
    if forward:
        return hit_at(ordered, 0 if now is None else now + 1)
    if now is None:
        return ordered.orderBy(F.col("hit").desc()).limit(1)
    return hit_at(ordered, now - 1)


def neighbours(ordered: DataFrame) -> DataFrame:
    """Each hit with the hits around it; computed from the contiguous ordinal, without a window."""
    last = ordered.agg(F.max("hit")).first()[0]
    return ordered.withColumn("previous", F.when(F.col("hit") > 0, F.col("hit") - 1)).withColumn("next", F.when(F.col("hit") < F.lit(last), F.col("hit") + 1))


def stored(ordered: DataFrame, quota: int) -> DataFrame:
    """Hits that fit a quota of bytes: a header, then a fixed size for each."""
    return ordered.where(F.col("hit") < max(0, (quota - HEADER_BYTES) // HIT_BYTES))


def quota_status(ordered: DataFrame, quota: int) -> DataFrame:
    """One row: hits stored, whether the quota was exceeded, bytes required, the row of the hit that was refused."""
    most = max(0, (quota - HEADER_BYTES) // HIT_BYTES)
    n = F.count("*")
    over = n > most
    return ordered.agg(
        F.least(n, F.lit(most)).alias("stored"),
        over.alias("exceeded"),
        F.when(over, F.lit(HEADER_BYTES + HIT_BYTES * (most + 1)).cast("long")).alias("required"),
        F.max(F.when(F.col("hit") == most, F.col("row"))).alias("rejected_row"),
    )


def revealed(found: DataFrame, order: DataFrame) -> DataFrame:
    """Hits with the rank of their row in a sorted view."""
    return found.join(order, "row")


