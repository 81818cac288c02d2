"""Word shingles as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a shingle.
WORDS = 5
WHITE = " \t\n\x0b\x0c\r"


def split_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; [''] if there is none, [''] for null."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE)), r"[\x20\x09-\x0D]+")


def split_normal_words(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script; [''] if there is none."""
    gap = r"[^\p{L}\p{N}]+"
    return F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"^{gap}|{gap}$", ""), gap)


def positions(words: Column, width: int = WORDS) -> Column:
    """Zero-based starts of the shingles of a word array."""
    n = F.size(words)
    return F.when((n >= width) & (F.get(words, F.lit(0)) != ""), F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def hash_at(words: Column, at: Column, width: int = WORDS) -> Column:
    """64-bit hash of the shingle that starts at ``at``."""
    return F.xxhash64(*(F.get(words, at + k) for k in range(width)))


def texts(words: Column, width: int = WORDS) -> Column:
    """All shingles of a word array as strings, repeats kept."""
    return F.transform(positions(words, width), lambda i: F.array_join(F.slice(words, i + 1, width), " "))


def hashes(words: Column) -> Column:
    return F.transform(positions(words), lambda i: hash_at(words, i))


def streamed(docs: DataFrame, words: Column, *keep: str, width: int = WORDS) -> DataFrame:
    """``keep``, ``at`` and ``h`` for every shingle: a generator, so hashing stays in generated code."""
    cut = docs.select(*keep, words.alias("_w"))
    return cut.select(*keep, "_w", F.explode(positions(F.col("_w"), width)).alias("at")).select(*keep, "at", hash_at(F.col("_w"), F.col("at"), width).alias("h"))
