"""Sorting a document by one column: bytes or exact numbers, stable in both directions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowatlas.functions.numeric_key import numeric_key
from rowatlas.operators.rows import ranked
from rowatlas.operators.view import ROWS, viewport


@dataclass(frozen=True)
class Request:
    """One zero-based column, ``text`` or ``numeric``, and a direction."""

    column: int
    mode: str = "text"
    descending: bool = False


def next_request(now: Request | None, clicked: int) -> Request | None:
    """What a click on a header asks for: column 0 is the row number and ends sorting."""
    if clicked < 1:
        return None
    if now and now.column == clicked - 1:
        return replace(now, descending=not now.descending)
    return Request(clicked - 1)


def field_key(fields: Column, column: int) -> Column:
    """The whole decoded field; empty where a record has fewer."""
    return F.coalesce(F.get(fields, F.lit(column)), F.lit(""))


def order_by(key: Column, mode: str = "text", descending: bool = False, row: str = "row") -> tuple[list[Column], list[Column]]:
    """Key columns to add, and the order over them; ties keep the source order."""
    to = lambda name: F.col(name).desc() if descending else F.col(name).asc()
    if mode == "text":
        return [key.alias("key")], [to("key"), F.col(row).asc()]
    if mode != "numeric":
        raise ValueError(f"unknown sort mode {mode!r}")
    return numeric_key(key), [F.col("grp").asc(), to("sign"), to("magnitude"), to("body"), F.col(row).asc()]


def sort_order(df: DataFrame, key: Column, mode: str = "text", descending: bool = False) -> DataFrame:
    """``rank, row`` of the whole document: both directions of lookup from one narrow frame."""
    columns, order = order_by(F.coalesce(key, F.lit("")), mode, descending)
    return ranked(df.select("row", *columns), order, "rank").select("rank", "row")


def first_page(df: DataFrame, key: Column, mode: str = "text", descending: bool = False, count: int = ROWS) -> DataFrame:
    """The first ranks without ranking everything: a top-k."""
    columns, order = order_by(F.coalesce(key, F.lit("")), mode, descending)
    top = df.select("row", *columns).orderBy(*order).limit(min(count, ROWS))
    return top.select((F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("rank"), "row")


def sorted_viewport(order: DataFrame, records: DataFrame, first: int, count: int = ROWS) -> DataFrame:
    """Records at ranks ``first`` on: the window (128 rows at most) is the broadcast side."""
    return records.join(F.broadcast(viewport(order, first, count, "rank")), "row")


def row_at(order: DataFrame, rank: int) -> DataFrame:
    return order.where(F.col("rank") == rank)


def rank_of(order: DataFrame, row: int) -> DataFrame:
    return order.where(F.col("row") == row)
