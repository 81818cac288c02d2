"""Query op3: a WARC record for every page, read back from the archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowatlas.llm import scratch, warc


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "warc")
    warc.write_archives(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), path, min_bytes=1000)
    return warc.read_archives(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS last FROM p WHERE strlen(html) >= 1000 GROUP BY d)
SELECT page_id, strlen(html) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND strlen(html) >= 1000
"""
