"""Files made from tables, so that registered queries read real files: delimited ones and workbooks.

They lie in the folder of ``spark.checkpoint.dir`` if one is named. Files of records are opened by workers,
so that folder must be mounted where they run; workbooks come through Spark's readers from any store.
"""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: str | None = None
_RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
SHEET_ROWS = 50_000


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder; without a shared one, below a local folder of this process that goes when it ends."""
    global _local
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        if _local is None:
            _local = tempfile.mkdtemp(prefix="rowatlas-files-")
            atexit.register(shutil.rmtree, _local, ignore_errors=True)
        base = _local
    return f"{base.rstrip('/')}/rowatlas-files/{name}-{uuid.uuid4().hex[:12]}"


def quoted(cell: Column) -> Column:
    """A cell between quotes, inner ones doubled."""
    return F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))


def write_records(records: DataFrame, name: str, one: bool = False) -> list[str]:
    """Write the one text column of ``records`` as files of records ended by LF; their local paths in order. ``one``: a single file, in the order of the frame."""
    folder = new_folder(records.sparkSession, name)
    (records.coalesce(1) if one else records).write.option("lineSep", "\n").text(folder)
    local = folder.removeprefix("file://").removeprefix("file:")
    return sorted(os.path.join(local, f) for f in os.listdir(local) if f.startswith("part-"))


def workbook(rows: Iterable[list[str]], formats: list[int]) -> bytes:
    """A workbook of one sheet. A cell is the inside of a <c> element with its attributes; style k has number format ``formats[k]``."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("_rels/.rels", f'<Relationships><Relationship Id="a" Type="{_RELATION}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_RELATION}"><sheets><sheet name="Kept" sheetId="1" r:id="r1"/><sheet name="Away" sheetId="2" state="hidden" r:id="r2"/></sheets></workbook>')
        links = [("r1", "worksheet", "worksheets/one.xml"), ("r2", "worksheet", "worksheets/two.xml"), ("r3", "styles", "styles.xml"), ("r4", "sharedStrings", "strings.xml")]
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{_RELATION}/{k}" Target="{t}"/>' for i, k, t in links) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{_MAIN}"><cellXfs>' + "".join(f'<xf numFmtId="{n}"/>' for n in formats) + "</cellXfs></styleSheet>")
        z.writestr("xl/strings.xml", f'<sst xmlns="{_MAIN}"><si><t>shared &amp; first</t></si><si><r><t>two</t></r><r><t> runs</t></r></si></sst>')
        z.writestr("xl/worksheets/two.xml", f'<worksheet xmlns="{_MAIN}"><sheetData/></worksheet>')
        with z.open("xl/worksheets/one.xml", "w") as sheet:
            sheet.write(f'<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
            for row in rows:
                sheet.write(("<row>" + "".join(row) + "</row>").encode())
            sheet.write(b"</sheetData></worksheet>")
    return out.getvalue()


def number_cell(value: str, style: int = 0) -> str:
    return f'<c s="{style}"><v>{value}</v></c>'


def text_cell(value: str) -> str:
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


def shared_cell(index: int) -> str:
    return f'<c t="s"><v>{index}</v></c>'


def boolean_cell(value: bool) -> str:
    return f'<c t="b"><v>{int(value)}</v></c>'


def write_workbooks(table: DataFrame, cells, formats: list[int], name: str) -> str:
    """Workbooks with a sheet row for each row of a table, SHEET_ROWS at most in each; ``cells`` makes the cells of a row. The folder they are in."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[str]] = []
        done = lambda: pa.RecordBatch.from_arrays([pa.array([workbook(held, formats)], pa.binary())], ["value"])
        for b in batches:
            for r in b.to_pylist():
                held.append(cells(r))
                if len(held) == SHEET_ROWS:
                    yield done()
                    held = []
        if held:
            yield done()

    folder = new_folder(table.sparkSession, name)
    # One workbook is one row of one file; the line end behind it is no part of the archive.
    table.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(folder)
    return folder
