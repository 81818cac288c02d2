"""Query op10: every license template in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowatlas.llm import licenses


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _values(rows) -> str:
    quoted = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
SQL = f"""
WITH t(license, text) AS (VALUES {_values(licenses.TEMPLATES.items())}),
c(up, stride, bands) AS (VALUES {_values(licenses.size_classes(400))}),
ts AS (SELECT DISTINCT license, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM (SELECT license, {_WORDS} AS w FROM t) WHERE len(w) >= 5),
tn AS (SELECT license, count(*) AS n FROM ts GROUP BY 1),
tc AS (SELECT license, n, min(stride) AS stride FROM tn JOIN c ON up >= n GROUP BY 1, 2),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
h AS (SELECT doc_id, license, i - 1 AS pos, s, n, stride FROM (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s FROM p) JOIN ts USING (s) JOIN tc USING (license)),
x AS (SELECT doc_id, license, s, n, stride, pos // stride - o AS k FROM h, (VALUES (0), (1)) AS v(o)),
m AS (SELECT doc_id, license, n, k * stride AS pos, count(DISTINCT s) AS shared FROM x WHERE k >= 0 GROUP BY ALL HAVING count(DISTINCT s) * 5 >= n * 4)
SELECT doc_id, license, n AS n_template, max(shared) AS n_shared, max(shared)::DOUBLE / n AS containment, arg_min(pos, (-shared, pos))::BIGINT AS at_word
FROM m GROUP BY doc_id, license, n
"""
