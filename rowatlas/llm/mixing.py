"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target in words. A document of a source whose target is r times
its size is taken floor(r) or floor(r) + 1 times. Fractions are rounded by pivotal
duels: two documents meet and move words between each other until one fraction is 0
or 1; a duel keeps both expectations and the sum of words. What stays fractional of
a group (one document) goes to the next level of a reduction tree, up to one document
for each source, which has nobody to meet and is rounded to the nearer side. So a
source misses its target by half of one document at most; all other expectations are
exact. Large documents meet first, so that the one that is left tends to be small.

Draws are hashes of ids and a seed: reruns agree, however tasks are dealt.

Defined cases: null texts and texts of white space have size 0 and are taken 0 words;
a null source is a source, last in order; documents with a null or repeated id take
part as rows of their own, and rows alike in id, text and source get the same copies, give or take one; an empty table gives an empty result; if all sizes are 0
all targets are 0; other columns are kept by ``with_copies`` only as asked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowatlas.llm import scratch
from rowatlas.llm.hot import join_counted

WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents of a leaf of the tree, and its fan-in.
LEAF = 4096
#: Rows of verdicts that are broadcast at most (about 40 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_ROWS = "doc_id long, tie long, src long, size long, alike long, whole long, frac double, copies long"
#: Sources (about 60 bytes each) whose targets are broadcast at most, and alike rows that one task lays out.
BROADCAST_SOURCES, LAID_OUT = 100_000, 100_000


def words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, src, n, source_size, target`` for a frame of ``source, size``.

    Sharing the excess of capped sources by weight until none is above its cap has
    a closed form: order sources by cap over weight; a prefix is capped and the rest
    get ``level * weight``. The windows run in one task over one row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    all_ = Window.orderBy((most * F.col("source_size")) / F.col("weight"), "src")
    upto = all_.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = by.select("source", place.cast("long").alias("src"), "n", "source_size", weight.alias("weight"))
    t = t.select("*", F.sum("source_size").over(everything).alias("total"), F.coalesce(F.sum(most * F.col("source_size")).over(upto), F.lit(0)).alias("capped"), (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0))).alias("open"))
    level = (F.col("total") - F.col("capped")) / F.col("open")
    t = t.withColumn("fits", F.when(level * F.col("weight") <= most * F.col("source_size"), level))
    t = t.withColumn("level", F.min_by("fits", F.when(F.col("fits").isNotNull(), F.col("capped"))).over(everything))
    share = F.col("level") * F.col("weight")
    capped = F.col("level").isNull() | (share > most * F.col("source_size"))
    return t.select("source", "src", "n", "source_size", F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def _draw(a: np.ndarray, b: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit integers and a level, by a mixing function."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) + np.uint64(b + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def pivotal(size: np.ndarray, frac: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Duels in the given order. Fractions after them, and the place of the one left (-1: none)."""
    p, eps, left = frac.astype(float).copy(), 1e-12, -1
    for k in range(len(p)):
        if p[k] <= eps or p[k] >= 1 - eps:
            p[k] = round(p[k])
            continue
        if left < 0:
            left = k
            continue
        a, b, si, sj = p[left], p[k], size[left], size[k]
        # Words move from one to the other until a fraction is 0 or 1.
        up, down = min((1 - a) * si, b * sj), min(a * si, (1 - b) * sj)
        if draws[k] * (up + down) < down:
            a, b = a + up / si, b - up / sj
        else:
            a, b = a - down / si, b + down / sj
        a, b = (round(x) if x <= eps or x >= 1 - eps else x for x in (a, b))
        p[left], p[k] = a, b
        if 0 < a < 1:
            continue
        left = k if 0 < b < 1 else -1
    return p, left


def _round_group(level: int, seed: int):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["size", "tie", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        p, left = pivotal(df["size"].to_numpy(), df["frac"].to_numpy(), _draw(df["tie"].to_numpy(), seed * 64 + level))
        settled = np.ones(len(df), bool)
        if left >= 0:
            settled[left] = False
        df["frac"] = p
        df["copies"] = pd.array(np.where(settled, df["whole"] + np.rint(p), 0).astype("int64"), dtype="Int64")
        df.loc[~settled, "copies"] = pd.NA
        return df[["doc_id", "tie", "src", "size", "alike", "whole", "frac", "copies"]]

    return run


def _tie(seed: int, source: str = "source") -> Column:
    """A hash of a row's id, text and source: alike rows have the same."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text", F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")))


def _rounded(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """``doc_id, tie, src, size, alike, copies, source_size, target``: one row for all rows that are alike, with their number and the copies they get together."""
    tables = scratch.Tables(spark)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tie(seed).alias("tie"), "source", words(F.col("text")).alias("size"))
    sized = tables.write(sized.groupBy("doc_id", "tie", "source", "size").agg(F.count("*").alias("alike")), "mix-sizes")
    wanted = targets(sized.select("source", (F.col("size") * F.col("alike")).alias("size")), weights, most)
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # a null source is a source, too
    wanted = tables.write(wanted.select(named.alias("name"), "src", "n", "source_size", "target"), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))  # of a source without words, nothing
    share = ratio * F.col("alike")
    whole = F.least(F.floor(share + 1e-12), most * F.col("alike")).cast("long")
    frac = F.when(F.col("size") > 0, F.greatest(share - whole, F.lit(0.0))).otherwise(F.lit(0.0))
    rows = _of_source(sized.withColumn("name", named), wanted, "name").select("doc_id", "tie", "src", "size", "alike", whole.alias("whole"), frac.alias("frac"), "n")
    leaves = F.pmod(F.col("tie"), F.greatest(F.ceil(F.col("n") / LEAF), F.lit(1)))
    most_rows = wanted.agg(F.max("n")).first()[0] or 0
    level, done = 0, []
    out = tables.write(rows.groupBy("src", leaves.alias("leaf")).applyInPandas(_round_group(0, seed), _ROWS), "mix-0")
    groups = -(-most_rows // LEAF)
    while groups > 1:
        done.append(out.where("copies is not null"))
        level, groups = level + 1, -(-groups // LEAF)
        left = out.where("copies is null")
        fan = F.pmod(F.xxhash64("tie", F.lit(level)), F.lit(groups))
        out = tables.write(left.groupBy("src", fan.alias("leaf")).applyInPandas(_round_group(level, seed), _ROWS), f"mix-{level}")
    out = out.withColumn("copies", F.coalesce("copies", F.col("whole") + (F.col("frac") >= 0.5).cast("int")))
    for part in done:
        out = out.unionByName(part)
    return _of_source(out, wanted.drop("name"), "src").select("doc_id", "tie", "src", "size", "alike", "copies", "source_size", "target")


def _of_source(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows with what is known of their source, whose name or number may be that of most rows."""
    return rows.join(F.broadcast(wanted), key) if wanted.count() <= BROADCAST_SOURCES else join_counted(rows, wanted, key, "n", rows.count())


def _each(rows: DataFrame) -> DataFrame:
    """``copies`` of each of the rows that are alike: they differ by one at most. Very many alike rows are laid out by many tasks."""
    cut = rows.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("alike") - 1) / LAID_OUT))))
    if rows.where(F.col("alike") > LAID_OUT).take(1):
        cut = cut.repartition("doc_id", "tie", "_k")
    first = F.col("_k") * LAID_OUT
    cut = cut.withColumn("_k", F.explode(F.sequence(first, F.least(first + LAID_OUT, F.col("alike")) - 1)))
    return cut.withColumn("copies", (F.floor(F.col("copies") / F.col("alike")) + (F.col("_k") < F.col("copies") % F.col("alike")).cast("int")).cast("int"))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 11) -> DataFrame:
    """``doc_id, tie, size, source_size, target, copies`` for every row of ``docs`` (doc_id, text, source).

    ``tie`` is a hash of the row's id, text and source. Rows alike in these are one participant with as many expected
    copies as all of them, so no group of the tree grows with repeats. Groups of a source are dealt by that
    hash, so a source with a third of all rows has a third of all groups.
    """
    return _each(_rounded(spark, docs, weights, most, seed)).select("doc_id", "tie", "size", "source_size", "target", "copies")


def with_copies(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    Rows alike in id, text and source share their copies; what does not divide evenly goes to one of them.
    """
    tables = scratch.Tables(spark)
    taken = _rounded(spark, docs, weights, most, seed).where("copies > 0")
    taken = taken.select(F.col("doc_id").alias("_d"), F.col("tie").alias("_t"), "alike", F.floor(F.col("copies") / F.col("alike")).cast("int").alias("_each"), (F.col("copies") % F.col("alike")).cast("int").alias("_more"))
    taken = tables.write(taken, "mix-copies")
    few = taken.count() <= BROADCAST_ROWS
    # Rows travel as one struct, so no name of theirs can clash.
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_own"), _tie(seed).alias("_t"))

    def repeated(verdict: DataFrame, times: str, once: bool) -> DataFrame:
        # The hash covers the id; ids are compared, too.
        rows = own.join(F.broadcast(verdict), "_t") if few else join_counted(own, verdict, "_t", "alike", verdict.agg(F.coalesce(F.sum("alike"), F.lit(0))).first()[0])
        rows = rows.where(F.col("_own").eqNullSafe(F.col("_d")))
        rows = rows.dropDuplicates(["_own", "_t"]) if once else rows
        return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col(times))).alias("k")).select("row.*")

    out = repeated(taken.where("_each > 0"), "_each", False)
    more = taken.where("_more > 0")
    return out.unionByName(repeated(more, "_more", True)) if more.take(1) else out
