"""Query op6: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowatlas.llm import html_text


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
