"""Query op9: token ids of every document, through ORC files and back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rowatlas.llm import tokens


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return tokens.round_trip(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))
