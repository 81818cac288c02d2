"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but
the last return the columns of ``documents``.

Defined cases: columns besides these are left out; null and empty texts are scored, are like nothing, contain
nothing, are taken by the mix as often as the whole part of their source's ratio says, and become the end id alone; rows with a null or repeated
doc_id are judged one by one; without labels of both kinds all documents have the same score (0.5 without any, which is
accepted); empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowatlas.llm import decontaminate, jaccard, mixing, quality, scratch, tokens

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    trees = quality.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, trees).where("score >= 0.5").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard.keep_one(spark, docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.with_copies(spark, docs).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC, and what is read back: doc_id, start, n_tokens, ids_crc32."""
    return tokens.round_trip(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokenize),
]

#: The classifier is no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = scratch.Tables(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = tables.write(stage(spark, docs, sf_dir), f"pipeline-{k}")
        tables.drop(f"pipeline-{k - 1}")
    return docs
