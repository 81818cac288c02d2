"""A document: lazy records with a source row, and every operation on them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowatlas.operators import columns, find, index, rows, sort, view
from rowatlas.sources import delimited, fields, formats, xlsx


@dataclass
class Document:
    """``records`` has ``row`` and ``fields`` (array of text), or ``text`` for whole records."""

    spark: SparkSession
    records: DataFrame
    kind: str = "fields"
    columns: columns.Columns = field(default_factory=lambda: columns.Columns(0))
    request: sort.Request | None = None

    @classmethod
    def from_table(cls, df: DataFrame, keys: list[str], cells: list[str]) -> Document:
        """A table in the order of its key columns; cells are text."""
        held = df.withColumn("fields", F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells)))
        return cls(df.sparkSession, rows.with_row(held, *keys), columns=columns.Columns(len(cells)))

    @classmethod
    def open(cls, spark: SparkSession, path: str, sheet: str | None = None) -> Document:
        """A local file by its suffix."""
        formats.check_path(path)
        kind = formats.infer_format(path)
        if kind == "xlsx":
            cells = xlsx.read_sheet(spark, path, sheet)
            return cls(spark, cells.withColumn("fields", F.transform("cells", lambda c: c["text"])), "cells", columns.Columns(xlsx.SHOWN_COLUMNS))
        records = delimited.read_records(spark, path)
        if kind == "lines":
            return cls(spark, records.withColumn("fields", F.array(F.col("bytes"))), "preview", columns.Columns(1))
        whole = fields.project_fields(records, delimited.dialect_of(path), fields.UNBOUNDED).drop("fields_truncated")
        return cls(spark, whole.withColumn("fields", F.transform("fields", lambda f: f["decoded"])), "fields", columns.Columns(columns.MOST))

    def count(self) -> int:
        return self.records.count()

    def width(self) -> DataFrame:
        return self.records.agg(rows.width(F.col("fields")).alias("width"))

    def titles(self) -> list[str]:
        return columns.titles(self.kind, self.columns.count)

    def viewport(self, first: int, count: int = view.ROWS) -> DataFrame:
        return view.viewport(self.records, first, count)

    def go_to(self, text: str) -> DataFrame:
        return self.viewport(view.parse_row(text), 1)

    def hide(self, column: int) -> Document:
        return Document(self.spark, self.records, self.kind, self.columns.hide(column), self.request)

    def show_all(self) -> Document:
        return Document(self.spark, self.records, self.kind, self.columns.show_all(), self.request)

    def shown(self) -> DataFrame:
        return self.records.withColumn("fields", columns.blank_hidden(F.col("fields"), self.columns))

    def _key(self, column: int) -> Column:
        if self.kind == "cells":
            raise ValueError("workbooks are not sorted")
        return F.coalesce(F.get("fields", F.lit(column)).cast("string"), F.lit(""))

    def sort(self, request: sort.Request) -> DataFrame:
        """``rank, row``; text compares bytes, so files keep their bytes as the key."""
        key = self._key(request.column)
        if request.mode == "text":
            key = F.coalesce(F.get("fields", F.lit(request.column)), F.lit("").cast(dict(self.records.dtypes)["fields"][6:-1]))
        return sort.sort_order(self.records, key, request.mode, request.descending)

    def sorted_viewport(self, order: DataFrame, first: int, count: int = view.ROWS) -> DataFrame:
        return sort.sorted_viewport(order, self.records, first, count)

    def find(self, needle: str, text: Column, case_sensitive: bool = True) -> DataFrame:
        """Ordered hits in whole records; hidden columns are searched, too."""
        if self.kind == "cells":
            raise ValueError("workbooks are not searched")
        return find.numbered(find.hits(self.records, text, needle, case_sensitive))

    def checkpoints(self, capacity: int = index.CAPACITY, stride: int = index.STRIDE) -> DataFrame:
        return index.row_index(self.records.select("row", F.col("start").alias("offset")), capacity, stride)


def summary_json(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: records and payload bytes of a table as JSON."""
    size = F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long")
    return df.agg(F.to_json(F.struct(F.count("*").alias("records"), size.alias("payload_bytes"))).alias("summary"))

