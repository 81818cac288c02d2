import zipfile

import pytest

from rowatlas.sources import xlsx

_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def book(path, sheets, strings=(), styles="", props="", extra=None, external=()):
    """A workbook of (name, state, sheet data) with shared strings and cell styles in XML."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("_rels/.rels", f'<Relationships><Relationship Id="a" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        tags = "".join(f'<sheet name="{n}" sheetId="{k}" {f"state=\"{s}\"" if s else ""} r:id="r{k}"/>' for k, (n, s, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN}" xmlns:r="{_REL}">{props}<sheets>{tags}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="r{k}" Type="{_REL}/worksheet" Target="{"http://x/y" if k in external else f"worksheets/s{k}.xml"}"{" TargetMode=\"External\"" if k in external else ""}/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships>{rels}<Relationship Id="s" Type="{_REL}/sharedStrings" Target="/xl/shared.xml"/><Relationship Id="t" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/shared.xml", f'<sst xmlns="{_MAIN}">{"".join(strings)}</sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{_MAIN}">{styles}</styleSheet>')
        for k, (_, _, data) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{data}</sheetData></worksheet>')
        for name, data in (extra or {}).items():
            z.writestr(name, data)
    return str(path)


_STYLES = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd h:mm:ss"/><numFmt numFmtId="165" formatCode="[h]:mm:ss"/><numFmt numFmtId="166" formatCode="&quot;Day &quot;0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/><xf numFmtId="10"/></cellXfs>'
_CELLS = [
    ('<c t="s"><v>0</v></c>', "bold and plain"), ('<c t="inlineStr"><is><t>inline text</t></is></c>', "inline text"), ('<c t="str"><f>"a"&amp;"b"</f><v>ab</v></c>', "ab"),
    ('<c t="b"><v>1</v></c>', "TRUE"), ('<c t="b"><v>0</v></c>', "FALSE"), ('<c t="b"><v>2</v></c>', "2"), ('<c t="e"><v>#DIV/0!</v></c>', "#DIV/0!"),
    ('<c t="d"><v>2024-02-29T00:00:00</v></c>', "2024-02-29T00:00:00"), ("<c><v>-1.5E-010</v></c>", "-1.5E-010"), ("<c><f>1+2</f><v></v></c>", ""), ('<c s="1"><v>45351</v></c>', "2024-02-29"),
    ('<c s="2"><v>45351.57326388889</v></c>', "2024-02-29 13:45:30"), ('<c s="3"><v>1.5</v></c>', "12:00:00"), ('<c s="4"><v>12345</v></c>', "12345"), ('<c s="5"><v>0.25</v></c>', "0.25"),
    ('<c s="1"><v>60</v></c>', "1900-02-29"), ('<c s="1"><v>-1</v></c>', "-1"), ('<c t="x"><v>007</v></c>', "007"), ('<c t="inlineStr"><is><t xml:space="preserve"> a\r\nb&#13; </t></is></c>', " a\nb\r "),
]


def test_cells_sheets_and_gaps(spark, tmp_path):
    strings = ["<si><r><t>bold</t></r><r><t> and plain</t></r><rPh><t>no</t></rPh></si>"]
    rows = "".join(f'<row r="{k}">{c}</row>' for k, (c, _) in enumerate(_CELLS, 1))
    sparse = '<row r="1"><c r="A1"><v>1</v></c></row><row r="3"><c r="C3"><v>3</v></c></row><row r="5"><c r="BR5"><v>9</v></c></row><row r="7"/>'
    path = book(tmp_path / "a.xlsx", [("Hidden", "hidden", ""), ("Types", "", rows), ("Sparse", "", sparse), ("Very", "veryHidden", "")], strings, _STYLES)
    got = xlsx.read_sheet(spark, path).orderBy("row").collect()
    assert [r.cells[0].text for r in got] == [w for _, w in _CELLS] and {r.sheet for r in got} == {"Types"}
    thin = xlsx.read_sheet(spark, path, "Sparse").orderBy("row").collect()
    assert [[c.text for c in r.cells] for r in thin][:4] == [["1"], [], ["", "", "3"], []]
    assert len(thin) == 7 and thin[4].truncated and len(thin[4].cells) == 64
    assert [r.offered for r in xlsx.read_sheets(spark, path).orderBy("position").collect()] == [False, True, True, False]
    with open(path, "rb") as f:
        held = xlsx.open_workbook(xlsx.Archive(f.read()))
    assert xlsx.turn(held, "Sparse") == "Types" and xlsx.turn(held, "Types", -1) == "Sparse"


def test_1904(tmp_path):
    path = book(tmp_path / "b.xlsx", [("S", "", '<row><c s="1"><v>0</v></c></row>')], styles=_STYLES, props='<workbookPr date1904="1"/>')
    with open(path, "rb") as f:
        archive = xlsx.Archive(f.read())
    held = xlsx.open_workbook(archive)
    assert [c for _, c, _ in xlsx.sheet_rows(archive, held, xlsx.pick(held))] == [[("1904-01-01", False)]]


@pytest.mark.parametrize(("code", "want"), [("yyyy-mm-dd", "date"), ("h:mm", "time"), ("m", "date"), ("[mm]:ss", "time"), ("dd/mm/yyyy hh:mm", "datetime"), ('"day"0', "plain"), ("\\d0", "plain"), ("[Red]0", "plain"), ("_d*h0", "plain"), ("General", "plain"), ("[$-409]mmm", "date")])
def test_format_codes(code, want):
    assert xlsx.format_kind(164, code) == want


def test_serials_and_booleans():
    serials = {"0": "1900-01-00", "1": "1900-01-01", "59": "1900-02-28", "60": "1900-02-29", "61": "1900-03-01", "40000": "2009-07-06", "2958465": "9999-12-31", "2958466": "2958466", "-1": "-1", "abc": "abc", "": ""}
    assert all(xlsx.serial_text(k, "date") == v for k, v in serials.items())
    assert xlsx.serial_text("0", "date", True) == "1904-01-01" and xlsx.serial_text("1.5", "time") == "12:00:00"
    assert xlsx.serial_text("40000.999999", "datetime") == "2009-07-07 00:00:00"
    assert [xlsx.cell_text("b", b, "", 0, xlsx.Workbook([], False))[0] for b in ("1", "0", "2")] == ["TRUE", "FALSE", "2"]


def test_targets():
    assert [xlsx._resolve("xl/workbook.xml", t) for t in ("a.xml", "/b/c.xml", "../d.xml", "../../../e.xml", "./f/../g.xml")] == ["xl/a.xml", "b/c.xml", "d.xml", "e.xml", "xl/g.xml"]


@pytest.mark.parametrize("data", ['<row r="x"/>', '<row r="1"><c s="-1"><v>1</v></c></row>', f'<row r="1"><c r="A1" t="{"y" * 70_000}"/></row>', '<row r="99999999999"/>'])
def test_damaged_attributes(tmp_path, data):
    with pytest.raises(xlsx.XlsxError):
        _rows(book(tmp_path / "z.xlsx", [("S", "", data)]))


def _rows(path):
    with open(path, "rb") as f:
        archive = xlsx.Archive(f.read())
    held = xlsx.open_workbook(archive)
    return list(xlsx.sheet_rows(archive, held, xlsx.pick(held)))


@pytest.mark.parametrize("data", ['<row r="2"/><row r="1"/>', '<row r="1"><c r="B1"/><c r="A1"/></row>', '<row r="1"><c r="A2"/></row>', '<row r="1048577"/>', '<row r="1"><c r="XFE1"/></row>', '<row r="1"><c t="s"><v>9</v></c></row>', '<row r="1"><c><v>&nope;</v></c></row>', "<row>"])
def test_refused_sheets(tmp_path, data):
    with pytest.raises(xlsx.XlsxError):
        _rows(book(tmp_path / "c.xlsx", [("S", "", data)]))


def test_refused_files(tmp_path):
    with pytest.raises(xlsx.XlsxError, match="OLE"):
        xlsx.Archive(b"\xd0\xcf\x11\xe0" + b"\0" * 100)
    with pytest.raises(xlsx.XlsxError):
        xlsx.Archive(b"PK no zip")
    with pytest.raises(xlsx.XlsxError, match="outside"):
        _rows(book(tmp_path / "d.xlsx", [("S", "", "")], external=(1,)))
    bomb = book(tmp_path / "e.xlsx", [("S", "", "<row>" + " " * (8 << 20) + "</row>")])
    with pytest.raises(xlsx.XlsxError, match="dense"):
        _rows(bomb)
    doctype = book(tmp_path / "f.xlsx", [("S", "", "")], extra={"xl/worksheets/s1.xml": '<!DOCTYPE x [<!ENTITY a "b">]><worksheet/>'})
    with pytest.raises(xlsx.XlsxError):
        _rows(doctype)
    raw = bytearray(open(book(tmp_path / "g.xlsx", [("S", "", "<row><c><v>1</v></c></row>" * 50)]), "rb").read())
    at = raw.find(b"xl/worksheets/s1.xml") + 30
    raw[at] ^= 0xFF
    (tmp_path / "h.xlsx").write_bytes(bytes(raw))
    with pytest.raises(xlsx.XlsxError):
        _rows(tmp_path / "h.xlsx")
