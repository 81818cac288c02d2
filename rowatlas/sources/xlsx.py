"""Worksheets of .xlsx workbooks as stored-value text.

Files come through Spark's ``binaryFile``, so from any store; a task handles one workbook.
The sheet is streamed through expat while it is inflated. Archives and XML are held to
fixed limits; whatever is beyond them, encrypted, or refers outside is refused.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import date, timedelta
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Limits of the format and of this reader.
ROWS, COLUMNS = 1_048_576, 16_384
ENTRY_BYTES, RATIO, RATIO_FROM, ENTRIES, DIRECTORY_BYTES = 1 << 30, 200, 1 << 20, 10_000, 4 << 20
STRINGS, STRING_BYTES, KEPT_BYTES = 16_777_216, 256 << 20, 1024
STYLES, SHEETS, TAG_BYTES = 65_536, 4096, 64 << 10
SHOWN_COLUMNS, CELL_BYTES, ROW_BYTES = 64, 1024, 4096
_CHUNK = 32 << 10


class XlsxError(ValueError):
    pass


def format_kind(number_format: int, code: str | None = None) -> str:
    """plain, date, time or datetime. A custom code's letters count outside of quotes, escapes and brackets."""
    if code is None:
        return {**dict.fromkeys(range(14, 18), "date"), **dict.fromkeys((18, 19, 20, 21, 45, 46, 47), "time"), 22: "datetime"}.get(number_format, "plain")
    elapsed = bool(re.search(r"\[(h+|m+|s+)\]", _SKIPPED.sub("", code), re.I))
    letters = set(re.sub(r"\[[^\]]*(\]|\Z)", "", _SKIPPED.sub("", code)).lower())
    time = elapsed or bool(letters & set("hs"))
    day = bool(letters & set("dy")) or ("m" in letters and not time)
    return "datetime" if day and time else "date" if day else "time" if time else "plain"


_SKIPPED = re.compile(r'"[^"]*("|\Z)|[\\_*].?', re.S)


def serial_text(stored: str, kind: str, date1904: bool = False) -> str:
    """A serial as text by its kind; anything else as stored."""
    if kind == "plain" or not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", stored.strip(), re.A):
        return stored
    value = float(stored)
    if not 0 <= value < 2_958_466:
        return stored
    days, seconds = divmod(int(value * 86_400 + 0.5), 86_400)
    clock = f"{seconds // 3600:02}:{seconds // 60 % 60:02}:{seconds % 60:02}"
    if kind == "time":
        return clock
    try:
        if date1904:
            day = (date(1904, 1, 1) + timedelta(days)).isoformat()
        else:
            day = {0: "1900-01-00", 60: "1900-02-29"}.get(days) or (date(1899, 12, 30) + timedelta(days + (days < 60))).isoformat()
    except OverflowError:
        return stored
    return day if kind == "date" else f"{day} {clock}"


@dataclass
class Sheet:
    name: str
    part: str | None
    visible: bool
    worksheet: bool

    @property
    def offered(self) -> bool:
        return self.visible and self.worksheet


@dataclass
class Workbook:
    sheets: list[Sheet]
    date1904: bool
    strings: list[str] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    strings_cut: set[int] = field(default_factory=set)


def _local(name: str) -> str:
    return name.rpartition("}")[2].rpartition(":")[2]


class Archive:
    """A ZIP within limits; sizes and ratio are checked on the bytes that come out, too."""

    def __init__(self, data: bytes):
        if data[:4] == b"\xd0\xcf\x11\xe0":
            raise XlsxError("an OLE file: encrypted or of the old format")
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, NotImplementedError) as e:
            raise XlsxError(f"no readable ZIP: {e}") from None
        names = self.zip.infolist()
        if b"PK\x06\x06" in data[-(1 << 16) :] or b"PK\x06\x07" in data[-(1 << 16) :]:
            raise XlsxError("ZIP64 archives are refused")
        if len(names) > ENTRIES or sum(46 + len(i.filename) + len(i.extra) + len(i.comment) for i in names) > DIRECTORY_BYTES:
            raise XlsxError("too many entries")
        self.entries = {i.filename: i for i in names}

    def has(self, part: str) -> bool:
        return part in self.entries

    def chunks(self, part: str) -> Iterator[bytes]:
        info = self.entries.get(part)
        if info is None:
            raise XlsxError(f"missing part {part}")
        if info.flag_bits & 1 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise XlsxError("encrypted, or a method other than stored and deflate")

        def fits(size: int) -> bool:
            return size <= ENTRY_BYTES and (size <= RATIO_FROM or size <= RATIO * max(1, info.compress_size))

        if not fits(info.file_size):
            raise XlsxError("an entry is too large or too dense")
        seen = 0
        try:
            with self.zip.open(info) as f:
                while block := f.read(_CHUNK):
                    seen += len(block)
                    if not fits(seen) or seen > info.file_size:
                        raise XlsxError("an entry is larger than its header says")
                    yield block
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError) as e:
            raise XlsxError(f"damaged entry {part}: {e}") from None
        if seen != info.file_size:
            raise XlsxError("an entry is shorter than its header says")

    def parse(self, part: str, start, end=None, text=None) -> None:
        """Stream a part through expat."""
        for _ in self.stream(part, start, end, text):
            pass

    def stream(self, part: str, start, end=None, text=None) -> Iterator[None]:
        """``parse`` that gives way after each block. UTF-8 only, no DOCTYPE, bounded tags."""
        parser = expat.ParserCreate("UTF-8")
        parser.buffer_text = True

        def refuse(*_):
            raise XlsxError("XML with a DOCTYPE or another encoding")

        def declared(version, encoding, standalone):
            if encoding and encoding.lower() not in ("utf-8", "utf8", "us-ascii", "ascii"):
                refuse()

        def opened(name, attributes):
            if len(name.encode()) + sum(len(k.encode()) + len(v.encode()) + 4 for k, v in attributes.items()) > TAG_BYTES:
                raise XlsxError("a tag is too long")
            start(_local(name), {_local(k) if not k.startswith("xmlns") else k: v for k, v in attributes.items()}, attributes)

        parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = refuse
        parser.XmlDeclHandler = declared
        parser.StartElementHandler = opened
        parser.EndElementHandler = (lambda name: end(_local(name))) if end else None
        parser.CharacterDataHandler = text
        try:
            for block in self.chunks(part):
                parser.Parse(block, False)
                yield
            parser.Parse(b"", True)
        except expat.ExpatError as e:
            raise XlsxError(f"bad XML in {part}: {e}") from None
        yield


def _number(text: str, what: str) -> int:
    """A number in an attribute, in ASCII digits."""
    if not re.fullmatch(r"[0-9]{1,10}", text):
        raise XlsxError(f"{what} {text[:40]!r} is no number")
    return int(text)


def _resolve(base: str, target: str) -> str:
    """The part that a target names from the folder of ``base``; steps above the root are dropped."""
    out: list[str] = []
    for step in (target if target.startswith("/") else posixpath.join(posixpath.dirname(base), target)).split("/"):
        if step == "..":
            out = out[:-1]
        elif step not in ("", "."):
            out.append(step)
    return "/".join(out)


def _relations(archive: Archive, part: str) -> dict[str, tuple[str, str | None]]:
    """id: (type, part); the part of an external target is None and never followed."""
    where = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
    found: dict[str, tuple[str, str | None]] = {}

    def start(name, a, _):
        if name == "Relationship":
            outside = a.get("TargetMode", "").lower() == "external"
            found[a.get("Id", "")] = (a.get("Type", ""), None if outside else _resolve(part, a.get("Target", "")))

    if archive.has(where):
        archive.parse(where, start)
    return found


def open_workbook(archive: Archive) -> Workbook:
    main = next((p for t, p in _relations(archive, "").values() if t.endswith("/officeDocument") and p), "xl/workbook.xml")
    relations = _relations(archive, main)
    sheets: list[Sheet] = []
    flags = {"1904": False}

    def start(name, a, raw):
        if name == "sheet":
            key = next((v for k, v in raw.items() if k.endswith(":id") or k == "id"), "")
            kind, part = relations.get(key, ("", None))
            sheets.append(Sheet(a.get("name", ""), part, a.get("state", "visible") not in ("hidden", "veryHidden"), kind.endswith("/worksheet")))
            if len(sheets) > SHEETS:
                raise XlsxError("too many sheets")
        elif name == "workbookPr":
            flags["1904"] = a.get("date1904", "") in ("1", "true")

    archive.parse(main, start)
    book = Workbook(sheets, flags["1904"])
    for kind, part in relations.values():
        if part and kind.endswith("/sharedStrings"):
            _strings(archive, part, book)
        elif part and kind.endswith("/styles"):
            _styles(archive, part, book)
    return book


def _cut(text: str, most: int) -> str:
    return text.encode("utf-8", "surrogatepass")[:most].decode("utf-8", "ignore")


class _Text:
    """Text of <t> elements outside of phonetic runs."""

    def __init__(self):
        self.parts: list[str] = []
        self.inside = self.phonetic = 0

    def start(self, name: str) -> None:
        self.phonetic += name == "rPh"
        self.inside += name == "t"

    def end(self, name: str) -> None:
        self.phonetic -= name == "rPh"
        self.inside -= name == "t"

    def text(self, data: str) -> None:
        if self.inside and not self.phonetic:
            self.parts.append(data)

    def take(self) -> str:
        out = "".join(self.parts)
        self.parts.clear()
        return out


def _strings(archive: Archive, part: str, book: Workbook) -> None:
    run, total = _Text(), 0

    def end(name):
        nonlocal total
        run.end(name)
        if name == "si":
            whole = run.take()
            size = len(whole.encode("utf-8", "surrogatepass"))
            total += size
            if total > STRING_BYTES or len(book.strings) >= STRINGS:
                raise XlsxError("too many shared strings")
            if size > KEPT_BYTES:
                book.strings_cut.add(len(book.strings))
            book.strings.append(_cut(whole, KEPT_BYTES))

    archive.parse(part, lambda name, a, raw: run.start(name), end, run.text)


def _styles(archive: Archive, part: str, book: Workbook) -> None:
    codes: dict[int, str] = {}
    ids: list[int] = []
    inside: list[str] = []

    def start(name, a, _):
        inside.append(name)
        if name == "numFmt" and "numFmts" in inside:
            codes[_number(a.get("numFmtId", "0"), "a number format")] = a.get("formatCode", "")
        elif name == "xf" and "cellXfs" in inside:
            ids.append(_number(a.get("numFmtId", "0"), "a number format"))
        if len(codes) > STYLES or len(ids) > STYLES:
            raise XlsxError("too many formats")

    archive.parse(part, start, lambda name: inside.pop())
    book.kinds = [format_kind(i, codes.get(i)) for i in ids]


def _place(reference: str, row: int) -> int:
    """Zero-based column of an A1 reference in its row."""
    m = re.fullmatch(r"([A-Z]{1,3})([0-9]+)", reference)
    if not m or int(m[2]) != row:
        raise XlsxError(f"bad cell reference {reference!r}")
    column = 0
    for c in m[1]:
        column = column * 26 + ord(c) - 64
    if column > COLUMNS:
        raise XlsxError("too many columns")
    return column - 1


def cell_text(kind: str, value: str, inline: str, style: int, book: Workbook) -> tuple[str, bool]:
    """Text of a cell by its type, and whether a shared string was cut."""
    if kind == "inlineStr":
        return inline, False
    if not value:
        return "", False
    if kind == "s":
        try:
            k = int(value.strip())
            return book.strings[k] if k >= 0 else book.strings[len(book.strings)], k in book.strings_cut
        except (ValueError, IndexError):
            raise XlsxError("no such shared string") from None
    if kind == "b":
        return {"1": "TRUE", "0": "FALSE"}.get(value, value), False
    if kind in ("", "n"):
        number_kind = book.kinds[style] if style < len(book.kinds) else "plain"
        return serial_text(value, number_kind, book.date1904), False
    return value, False


def sheet_rows(archive: Archive, book: Workbook, sheet: Sheet) -> Iterator[tuple[int, list[tuple[str, bool]], bool]]:
    """(zero-based row, cells as (text, truncated), row truncated) for every row to the last stored one.

    Rows wait in a queue only while a block of XML is parsed.
    """
    if sheet.part is None:
        raise XlsxError("the sheet is outside of the package")
    done: list[tuple[int, list[tuple[str, bool]], bool]] = []
    run = _Text()
    state = {"row": 0, "column": -1, "cells": [], "wide": False, "left": ROW_BYTES, "cell": None, "value": None, "next": 0}

    def start(name, a, _):
        run.start(name)
        if name == "row":
            number = _number(a["r"], "a row") if "r" in a else state["row"] + 1
            if not state["row"] < number <= ROWS:
                raise XlsxError("rows are out of order")
            state.update(row=number, column=-1, cells=[], wide=False, left=ROW_BYTES)
        elif name == "c":
            column = _place(a["r"], state["row"]) if "r" in a else state["column"] + 1
            if not state["column"] < column < COLUMNS:
                raise XlsxError("cells are out of order")
            state.update(column=column, cell=(a.get("t", ""), _number(a.get("s", "0"), "a style")), value=[])
            run.parts.clear()
        elif name == "v" and state["cell"]:
            state["inside"] = True

    def text(data):
        run.text(data)
        if state.get("inside"):
            state["value"].append(data)

    def end(name):
        run.end(name)
        if name == "v":
            state["inside"] = False
        elif name == "c":
            kind, style = state["cell"]
            said, cut = cell_text(kind, "".join(state["value"]), run.take(), style, book)
            state["cell"] = None
            if state["column"] >= SHOWN_COLUMNS:
                state["wide"] = True
                gap = SHOWN_COLUMNS - len(state["cells"])
                state["cells"] += [("", False)] * gap
                return
            state["cells"] += [("", False)] * (state["column"] - len(state["cells"]))
            kept = _cut(said, min(CELL_BYTES, state["left"]))
            state["left"] -= len(kept.encode("utf-8", "surrogatepass"))
            state["cells"].append((kept, cut or kept != said))
        elif name == "row":
            cells = state["cells"]
            done.append((state["row"] - 1, cells, state["wide"] or any(c for _, c in cells)))

    last = -1
    for _ in archive.stream(sheet.part, start, end, text):
        rows, done[:] = list(done), []
        for number, cells, cut in rows:
            for missing in range(last + 1, number):
                yield missing, [], False
            yield number, cells, cut
            last = number


def pick(book: Workbook, name: str | None = None) -> Sheet:
    """The named sheet among the offered ones, or the first of them."""
    offered = [s for s in book.sheets if s.offered and (name is None or s.name == name)]
    if not offered:
        raise XlsxError("no such sheet" if name else "no visible worksheet")
    return offered[0]


def turn(book: Workbook, now: str, by: int = 1) -> str:
    """The next or previous offered sheet, around the ends."""
    names = [s.name for s in book.sheets if s.offered]
    return names[(names.index(now) + by) % len(names)]


_ROW = "path string, sheet string, row long, cells array<struct<text:string,truncated:boolean>>, truncated boolean"
_SHEET = "path string, position int, name string, visible boolean, worksheet boolean, offered boolean"


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """``path, sheet, row, cells, truncated`` of one sheet of each workbook under ``path``."""
    kind = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.struct([("text", pa.string()), ("truncated", pa.bool_())]))), ("truncated", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                archive = Archive(data.as_py())
                book = open_workbook(archive)
                chosen, held = pick(book, sheet), []
                for row, cells, cut in sheet_rows(archive, book, chosen):
                    held.append({"path": where, "sheet": chosen.name, "row": row, "cells": [{"text": t, "truncated": c} for t, c in cells], "truncated": cut})
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_pylist(held, kind)
                        held = []
                yield pa.RecordBatch.from_pylist(held, kind)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _ROW)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """All sheets of each workbook, in order."""
    kind = pa.schema([("path", pa.string()), ("position", pa.int32()), ("name", pa.string()), ("visible", pa.bool_()), ("worksheet", pa.bool_()), ("offered", pa.bool_())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for where, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                book = open_workbook(Archive(data.as_py()))
                yield pa.RecordBatch.from_pylist([{"path": where, "position": k, "name": s.name, "visible": s.visible, "worksheet": s.worksheet, "offered": s.offered} for k, s in enumerate(book.sheets)], kind)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _SHEET)
