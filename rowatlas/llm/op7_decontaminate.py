"""Query op7: every document and benchmark item it contains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowatlas.llm import decontaminate


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
v AS (SELECT DISTINCT least(len(w), 5) AS n FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS s FROM d, v WHERE len(w) >= n),
bs AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS s FROM b JOIN v ON v.n = least(len(w), 5)),
bn AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY 1)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*)::DOUBLE / n_item AS containment
FROM ds JOIN bs USING (s, n) JOIN bn USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) * 5 >= n_item * 4
"""
