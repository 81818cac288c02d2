"""Benchmark decontamination: which documents contain which test items.

A document contains an item if at least 0.8 of the item's distinct five-word
shingles are among its own. Size-partitioned MinHash containment search finds
candidates: items are partitioned by their number of shingles, and each keeps its k
smallest shingle hashes (a bottom-k MinHash sketch), k by partition. A document that
contains the item lacks at most a fifth of its shingles, so for small partitions some
sketch value always occurs in it, and for large ones all k are missing with a
probability under 0.2^k. Documents are not sketched: a short item is a thousandth
of a long document, which no signature of the document would show. Their
hashes stream past the broadcast sketches in generated code, without a shuffle;
beyond a counted bound the sketches are taken in blocks. Candidates are verified by
the exact shingles as strings.

An item of one to four words is one shingle, all its words: a document contains it if they stand there in a
row, so documents are cut into shingles of these widths, too, where there are such items.

Defined cases: null and empty texts contain and are contained by nothing; an item_id with several texts has the
best of their containments; rows that share a doc_id (null too) or an item_id count as one, with the best of their
containments, but ``clean`` judges each text of a doc_id alone; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowatlas.llm import scratch
from rowatlas.llm import shingles as S

#: Containment as a fraction, exact in integers.
SHARE = (4, 5)
#: Probability that all sketch values of an item are missing.
MISS = 1e-9
#: Rows of sketches or candidates that are broadcast at most (16 bytes of data each).
BROADCAST_ROWS = 500_000
#: Bytes of item texts that are broadcast at most.
BROADCAST_BYTES = 32 << 20


def sketch_size(n: Column) -> Column:
    """k of an item with n shingles, by the upper end of its partition [2^c, 2^(c+1))."""
    up = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double"))) + 1).cast("int") - 1
    enough = math.ceil(math.log(MISS) / math.log(1 - SHARE[0] / SHARE[1]))
    return F.least((up * (SHARE[1] - SHARE[0]) / SHARE[1]).cast("int") + 1, F.lit(enough))


def _items(benchmark: DataFrame, least_words: int) -> DataFrame:
    """``item_id, width, shingles, n_item, sketch`` of items with a shingle; an item of fewer words than a shingle has is one shingle."""
    cut = benchmark.select(F.col("item_id").cast("long").alias("item_id"), S.split_words(F.col("text")).alias("w")).where((F.get("w", F.lit(0)) != "") & (F.size("w") >= least_words))
    long_ = cut.where(F.size("w") >= S.WORDS).select("item_id", F.lit(S.WORDS).alias("width"), F.array_distinct(S.texts(F.col("w"))).alias("shingles"), F.array_sort(F.array_distinct(S.hashes(F.col("w")))).alias("hs"))
    short = [cut.where(F.size("w") == n).select("item_id", F.lit(n).alias("width"), F.array(F.array_join("w", " ")).alias("shingles"), F.array(S.hash_at(F.col("w"), F.lit(0), n)).alias("hs")) for n in range(least_words, S.WORDS)]
    own = reduce(DataFrame.unionByName, short, long_)
    return own.select("item_id", "width", "shingles", F.size("shingles").cast("long").alias("n_item"), F.slice("hs", F.lit(1), sketch_size(F.size("hs"))).alias("sketch"))


def contained(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least_words: int = 1) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared, containment`` for every document and item (of ``least_words`` or more) it contains."""
    checked = _checked(spark, _told_apart(docs), benchmark, least_words)
    best = F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item")).alias("b")
    return checked.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.n_item", "b.n_shared", "b.containment")


def _told_apart(docs: DataFrame) -> DataFrame:
    """``doc_id, tk, text``: rows are told apart by id and digest of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("tk"), "text")


def _checked(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least_words: int) -> DataFrame:
    """``doc_id, tk, item_id, n_item, n_shared`` for every document of ``docs`` and item it contains; rows alike in both keys are one document."""
    tables = scratch.Tables(spark)
    items = tables.write(_items(benchmark, least_words), "items")
    size = items.agg(F.coalesce(F.sum(F.size("sketch")), F.lit(0)), F.coalesce(F.sum(F.octet_length(F.array_join("shingles", " "))), F.lit(0))).first()
    widths = sorted(r.width for r in items.select("width").distinct().collect())
    words = S.split_words(F.col("text"))
    found = []
    for width in widths or [S.WORDS]:
        sketches = items.where(F.col("width") == width).select(F.explode("sketch").alias("h"), "item_id").distinct()
        for part in _blocks(sketches, F.col("h"), math.ceil(size[0] / BROADCAST_ROWS)):
            found.append(S.streamed(docs, words, "doc_id", "tk", width=width).join(F.broadcast(part), "h").select("doc_id", "tk", "item_id"))
    candidates = tables.write(reduce(DataFrame.unionByName, found).distinct(), "candidates")
    few = candidates.count() <= BROADCAST_ROWS
    some = candidates.select(F.col("doc_id").alias("_d"), F.col("tk").alias("_t")).distinct()
    near = docs.join(F.broadcast(some) if few else some, (F.col("tk") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    near = near.select("doc_id", "tk", words.alias("w"))
    shared = []
    for width in widths or [S.WORDS]:  # each candidate document is cut into its shingles once, and meets those of all items
        own = near.select("doc_id", "tk", F.explode(F.array_distinct(S.texts(F.col("w"), width))).alias("s"))
        of_items = items.where(F.col("width") == width).select(F.explode("shingles").alias("s"), "item_id", "n_item").distinct()
        for part in _blocks(of_items, F.xxhash64("s"), math.ceil(size[1] / BROADCAST_BYTES)):
            shared.append(own.join(F.broadcast(part), "s").groupBy("doc_id", "tk", "item_id", "n_item", "s").agg(F.lit(1).alias("one")).groupBy("doc_id", "tk", "item_id", "n_item").agg(F.count("*").alias("n")))
    counted = reduce(DataFrame.unionByName, shared).groupBy("doc_id", "tk", "item_id", "n_item").agg(F.sum("n").cast("long").alias("n_shared"))
    counted = counted.where(F.col("n_shared") * SHARE[1] >= F.col("n_item") * SHARE[0])
    # Only candidates count: an item and a document that share enough are one but for the probability MISS.
    pairs = candidates.select(F.col("doc_id").alias("_d"), F.col("tk").alias("_t"), F.col("item_id").alias("_i"))
    same = (F.col("tk") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("item_id").eqNullSafe(F.col("_i"))
    return counted.join(F.broadcast(pairs) if few else pairs, same, "left_semi")


def _blocks(df: DataFrame, key: Column, blocks: int) -> list[DataFrame]:
    """``df`` in so many parts by a hash."""
    return [df.where(F.pmod(key, F.lit(blocks)) == b) for b in range(blocks)] if blocks > 1 else [df]


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, least_words: int = 3) -> DataFrame:
    """``docs`` without the rows that contain an item, with all columns; rows are told apart by doc_id and text.

    Items of one or two words stand in clean texts, too, and take no document with them, unless ``least_words`` says so.
    """
    # Rows travel as one struct, so no name of theirs can clash.
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("tk"))
    found = _checked(spark, _told_apart(docs), benchmark, least_words)
    dirty = scratch.Tables(spark).write(found.select(F.col("doc_id").alias("_d"), F.col("tk").alias("_t")).distinct(), "contaminated")
    few = dirty.count() <= BROADCAST_ROWS
    return own.join(F.broadcast(dirty) if few else dirty, (F.col("tk") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_anti").select("row.*")
