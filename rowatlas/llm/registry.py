"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from rowatlas.llm import (
    op1_jaccard,
    op2_chat,
    op3_warc,
    op4_mixing,
    op5_quality,
    op6_html,
    op7_decontaminate,
    op8_nearest,
    op9_tokens,
    op10_licenses,
)

#: Query name and module with run(spark, sf_dir) and, where SQL can express it, SQL.
OPERATORS = {
    "op1_jaccard": op1_jaccard,
    "op2_chat_format": op2_chat,
    "op3_warc": op3_warc,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_html_text": op6_html,
    "op7_decontaminate": op7_decontaminate,
    "op8_nearest": op8_nearest,
    "op9_tokens": op9_tokens,
    "op10_licenses": op10_licenses,
}


def queries() -> dict:
    return {q: m.run for q, m in OPERATORS.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {q: getattr(m, "SQL", None) for q, m in OPERATORS.items()} | {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {q: sql for q, sql in found.items() if sql}
