"""Bounded views: windows of rows, previews, going to a row, moving a window."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS = 128
PREVIEW_BYTES = 4096
_U64 = (1 << 64) - 1


def viewport(df: DataFrame, first: int, count: int = ROWS, by: str = "row") -> DataFrame:
    """Rows ``first`` up to ``count`` (128 at most): a range filter."""
    return df.where(F.col(by).between(first, first + min(count, ROWS) - 1))


def first_rows(df: DataFrame, *keys: str, count: int = ROWS) -> DataFrame:
    """The first window in the order of the keys, before any other row is placed: a top-k of the scan."""
    top = df.orderBy(*(F.col(k).asc_nulls_first() for k in keys)).limit(min(count, ROWS))
    return top.withColumn("row", (F.row_number().over(Window.orderBy(*(F.col(k).asc_nulls_first() for k in keys))) - 1).cast("long"))


def any_flags(df: DataFrame, *flags: str) -> DataFrame:
    """One row: whether any row has each flag; false without rows."""
    return df.agg(*(F.coalesce(F.bool_or(f), F.lit(False)).alias(f"any_{f}") for f in flags))


def window_json(window: DataFrame, text: str = "preview") -> DataFrame:
    """``row, json``: rows of a window as JSON, with their preview as text (what is no UTF-8 is replaced), its bytes, and whether it was cut."""
    raw = F.col(text).cast("binary")
    shown = F.coalesce(F.make_valid_utf8(raw.cast("string")), F.lit(""))
    return window.select("row", F.to_json(F.struct("row", shown.alias("preview_utf8_lossy"), F.octet_length(raw).alias("preview_bytes"), "truncated")).alias("json"))


def reached_end(df: DataFrame, first: int, count: int = ROWS, by: str = "row") -> DataFrame:
    """One row: whether a window reaches beyond the last row."""
    return df.agg((F.coalesce(F.max(by), F.lit(-1)) < first + min(count, ROWS)).alias("reached_eof"))


def preview(df: DataFrame, column: str = "bytes", most: int = PREVIEW_BYTES) -> DataFrame:
    """The first bytes of each record, and whether it has more."""
    raw = F.col(column).cast("binary")
    return df.withColumn("preview", F.substring(raw, 1, most)).withColumn("truncated", F.octet_length(raw) > most)


def within_payload(df: DataFrame, most: int, column: str = "preview", by: str = "row") -> DataFrame:
    """A window's previews cut so that they stay inside a total of bytes, in order. For windows (128 rows) only."""
    before = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(most) - F.coalesce(F.sum(F.octet_length(column)).over(before), F.lit(0)), F.lit(0))
    kept = df.withColumn("_left", left.cast("int"))
    return kept.withColumn("truncated", F.col("truncated") | (F.octet_length(column) > F.col("_left"))).withColumn(column, F.expr(f"substring({column}, 1, _left)")).drop("_left")


def parse_row(text: str) -> int:
    """The zero-based row of a one-based number in ASCII digits."""
    if not text:
        raise ValueError("enter a row number")
    if any(c not in "0123456789" for c in text):
        raise ValueError("use decimal digits only")
    value = int(text)
    if value > _U64:
        raise ValueError("the row number is beyond 64 bits")
    if value == 0:
        raise ValueError("row numbers start at 1")
    return value - 1


@dataclass(frozen=True)
class RowWindow:
    """A window of ``visible`` rows that starts at ``first`` of ``total``."""

    total: int
    visible: int
    first: int = 0

    @property
    def last_first(self) -> int:
        return max(0, self.total - min(self.visible, self.total))

    def seek(self, first: int) -> RowWindow:
        return replace(self, first=min(max(0, first), self.last_first))

    def center(self, row: int) -> RowWindow:
        return self.seek(min(row, max(0, self.total - 1)) - min(self.visible, self.total) // 2)

    def scroll(self, by: int) -> RowWindow:
        return self.seek(min(self.first + by, _U64))

    def absolute(self, local: int) -> int | None:
        row = self.first + local
        return row if 0 <= local < min(self.visible, self.total) and row < self.total else None
