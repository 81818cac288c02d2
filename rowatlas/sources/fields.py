"""Fields of one delimited record, decoded and bounded."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from rowatlas.sources.scanner import CSV, Dialect

MOST_FIELDS, FIELD_BYTES, ROW_BYTES = 64, 1024, 4096
SCHEMA = "ordinal int, raw_start long, raw_end long, decoded binary, quoted boolean, escaped_quotes boolean, raw_truncated boolean, decoded_truncated boolean, utf8_status string"


@dataclass(frozen=True)
class Limits:
    fields: int = MOST_FIELDS
    field_bytes: int = FIELD_BYTES
    row_bytes: int = ROW_BYTES


UNBOUNDED = Limits(1 << 31, 1 << 31, 1 << 62)


def utf8_status(raw: bytes, truncated: bool) -> str:
    """Valid, invalid, or incomplete: cut inside the last character."""
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError as e:
        return "incomplete" if truncated and e.reason == "unexpected end of data" else "invalid"
    return "valid"


def _pieces(record: bytes, dialect: Dialect) -> Iterator[tuple[int, int, bytes, bool, bool]]:
    """(start, end, decoded, quoted, escaped) of every field; an empty record has one."""
    delimiter, quote, at, n = bytes([dialect.delimiter]), bytes([dialect.quote]), 0, len(record)
    while True:
        start, parts, quoted, escaped = at, [], False, False
        if record[at : at + 1] == quote:
            quoted, at = True, at + 1
            while True:
                close = record.find(quote, at)
                if close < 0:  # never closed: the rest of the record
                    parts.append(record[at:])
                    at = n
                    break
                parts.append(record[at:close])
                at = close + 1
                if record[at : at + 1] != quote:
                    break
                parts.append(quote)
                escaped, at = True, at + 1
        end = record.find(delimiter, at)
        end = n if end < 0 else end
        parts.append(record[at:end])
        yield start, end, b"".join(parts), quoted, escaped
        if end == n:
            return
        at = end + 1


def project(record: bytes, dialect: Dialect = CSV, limits: Limits = Limits(), truncated: bool = False, base: int = 0) -> tuple[list[dict], bool]:
    """The record's fields, and whether there are more than are allowed.

    ``truncated`` says that the record itself was cut: its last field is then cut too.
    The bytes of a row are given out from the left.
    """
    out: list[dict] = []
    left = limits.row_bytes
    for start, end, decoded, quoted, escaped in _pieces(record, dialect):
        if len(out) == limits.fields:
            return out, True
        kept = decoded[: min(limits.field_bytes, left)]
        left -= len(kept)
        cut = truncated and end == len(record)
        short = cut or len(kept) < len(decoded)
        out.append({"ordinal": len(out), "raw_start": base + start, "raw_end": base + end, "decoded": kept, "quoted": quoted, "escaped_quotes": escaped, "raw_truncated": cut, "decoded_truncated": short, "utf8_status": utf8_status(kept, short)})
    return out, False


def project_fields(records: DataFrame, dialect: Dialect = CSV, limits: Limits = Limits()) -> DataFrame:
    """``records`` (row, start, bytes, perhaps truncated) with ``fields`` and ``fields_truncated``, in one pass; columns of these names are replaced."""
    held = records.drop("fields", "fields_truncated")
    cut = "truncated" in held.columns
    types = [("ordinal", pa.int32()), ("raw_start", pa.int64()), ("raw_end", pa.int64()), ("decoded", pa.binary()), ("quoted", pa.bool_()), ("escaped_quotes", pa.bool_()), ("raw_truncated", pa.bool_()), ("decoded_truncated", pa.bool_()), ("utf8_status", pa.string())]
    kind = pa.list_(pa.struct(types))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = b.column("truncated").to_pylist() if cut else [False] * b.num_rows
            rows = [project(r, dialect, limits, bool(t), s) for r, s, t in zip(b.column("bytes").to_pylist(), b.column("start").to_pylist(), short, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f for f, _ in rows], kind), pa.array([m for _, m in rows], pa.bool_())], [*b.schema.names, "fields", "fields_truncated"])

    inner = ", ".join(x.strip().replace(" ", ":", 1) for x in SCHEMA.split(","))
    added = StructType.fromDDL(f"fields array<struct<{inner}>>, fields_truncated boolean")
    return held.mapInArrow(run, StructType([*held.schema.fields, *added.fields]))
