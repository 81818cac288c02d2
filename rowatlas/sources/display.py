"""Records as bounded display text: escapes, invalid bytes, UTF-16 bounds."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL_UNITS = 1024
MARK = " ..."
_SHORT = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}


def escaped(raw: bytes) -> tuple[str, bool]:
    """Visible text of bytes, and whether some were not UTF-8."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(_visible(raw[at:].decode("utf-8")))
            break
        except UnicodeDecodeError as e:
            out.append(_visible(raw[at : at + e.start].decode("utf-8")))
            out.append("".join(f"\\x{b:02X}" for b in raw[at + e.start : at + e.end]))
            at += e.end
    return "".join(out), bool(len(out) > 1)


def _visible(text: str) -> str:
    if text.isprintable():
        return text
    return "".join(_SHORT.get(c) or (f"\\u{{{ord(c):X}}}" if unicodedata.category(c) == "Cc" else c) for c in text)


def utf16_units(text: str) -> int:
    return len(text) + sum(c > "￿" for c in text)


def utf16_prefix(text: str, units: int) -> str:
    """The longest prefix of whole characters within so many UTF-16 units."""
    if len(text) * 2 <= units:
        return text
    used = 0
    for k, c in enumerate(text):
        used += 1 + (c > "￿")
        if used > units:
            return text[:k]
    return text


def utf8_prefix(text: str, most: int) -> str:
    """The longest prefix of whole characters within so many bytes."""
    return text.encode("utf-8", "surrogatepass")[:most].decode("utf-8", "ignore")


def render(raw: bytes, source_truncated: bool = False, units: int = CELL_UNITS) -> tuple[str, bool, bool]:
    """(text, display_truncated, escaped_non_utf8); a cut text ends in a mark."""
    text, bad = escaped(raw)
    over = utf16_units(text) > units
    if over or source_truncated:
        text = utf16_prefix(text, units - len(MARK)) + MARK
    return text, over, bad


def rendered(df: DataFrame, raw: str = "bytes", truncated: str | None = None) -> DataFrame:
    """``row, text, source_truncated, display_truncated, escaped_non_utf8`` by Arrow batches."""
    cut = df.select("row", F.col(raw).cast("binary").alias("raw"), (F.col(truncated) if truncated else F.lit(False)).alias("cut"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = b.column("cut").to_pylist()
            out = [render(r or b"", bool(c)) for r, c in zip(b.column("raw").to_pylist(), cuts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([o[0] for o in out], pa.string()), pa.array([bool(c) for c in cuts]), pa.array([o[1] for o in out], pa.bool_()), pa.array([o[2] for o in out], pa.bool_())], ["row", "text", "source_truncated", "display_truncated", "escaped_non_utf8"])

    return cut.mapInArrow(run, "row long, text string, source_truncated boolean, display_truncated boolean, escaped_non_utf8 boolean")
