"""Query op1: near-duplicate class and number of links of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowatlas.llm import jaccard


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE c * 5 >= (p.n + q.n - c) * 4),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT doc_id, least(doc_id, coalesce(m, doc_id)) AS class_id, coalesce(k, 0) AS n_links
FROM documents LEFT JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) a ON a.x = doc_id LEFT JOIN (SELECT x, count(*) AS k FROM l GROUP BY x) b ON b.x = doc_id
"""
