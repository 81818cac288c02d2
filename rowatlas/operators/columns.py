"""Shown and hidden columns of a document, and copying what is shown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowatlas.functions.text import row_label

MOST = 64
COPY_ROWS, COPY_BYTES = 4096, 1 << 20


@dataclass(frozen=True)
class Columns:
    """Data columns 1 to ``count``; some are hidden, never all."""

    count: int
    hidden: frozenset[int] = frozenset()

    def visible(self) -> list[int]:
        return [c for c in range(1, min(self.count, MOST) + 1) if c not in self.hidden]

    def can_hide(self, column: int) -> bool:
        return 1 <= column <= min(self.count, MOST) and column not in self.hidden and len(self.visible()) > 1

    def hide(self, column: int) -> Columns:
        return Columns(self.count, self.hidden | {column}) if self.can_hide(column) else self

    def show_all(self) -> Columns:
        return Columns(self.count)

    def file_column(self, shown: int) -> int | None:
        """The data column at a shown place; place 0 is the row number."""
        places = [0, *self.visible()]
        return places[shown] if 0 <= shown < len(places) else None

    def shown_place(self, column: int) -> int | None:
        places = [0, *self.visible()]
        return places.index(column) if column in places else None


def letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def titles(kind: str, count: int) -> list[str]:
    """Titles of the data columns: of lines, delimited records or a sheet."""
    if kind == "preview":
        return ["Preview"]
    name = {"fields": lambda k: f"Column {k}", "cells": letters}[kind]
    return [name(k) for k in range(1, min(count, MOST) + 1)]


def blank_hidden(fields: Column, columns: Columns) -> Column:
    """Hidden fields are empty; places stay."""
    away = F.array(*map(F.lit, sorted(columns.hidden))) if columns.hidden else F.array().cast("array<int>")
    return F.transform(fields, lambda f, i: F.when(F.array_contains(away, i + 1), F.lit("")).otherwise(f))


def shown(df: DataFrame, names: list[str], columns: Columns) -> DataFrame:
    """``row`` and the visible ones of the named columns: the scan reads no other."""
    return df.select("row", *(names[c - 1] for c in columns.visible()))


def copy_lines(df: DataFrame, cells: Column) -> DataFrame:
    """``row, line``: the row number and the cells, by tabs. ``cells`` holds shown, rendered cells."""
    return df.select("row", F.concat_ws("\t", row_label(F.col("row")), F.array_join(cells, "\t")).alias("line"))


def copy_text(lines: DataFrame) -> DataFrame:
    """One row ``text``: lines joined by CR LF, 1 to 4,096 rows and 1 MiB in UTF-16 with its end; more is an error.

    The bound is checked on counts before any line is gathered.
    """
    size = lines.agg(F.count("*").alias("n"), F.coalesce(F.sum(_utf16(F.col("line"))), F.lit(0)).alias("units")).first()
    if not 1 <= size.n <= COPY_ROWS:
        raise ValueError(f"a copy takes 1 to {COPY_ROWS} rows, not {size.n}")
    if 2 * (size.units + 2 * (size.n - 1) + 1) > COPY_BYTES:
        raise ValueError(f"a copy takes {COPY_BYTES} bytes at most")
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\r\n").alias("text"))


def _utf16(text: Column) -> Column:
    """UTF-16 units of a string: one more for each character of four bytes."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
