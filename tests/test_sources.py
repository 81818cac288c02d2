import os
import random

import pytest
from pyspark.sql import functions as F

from rowatlas.sources import delimited, fields, formats, lines
from rowatlas.sources.display import render, rendered, utf8_prefix, utf16_prefix
from rowatlas.sources.fields import UNBOUNDED, Limits, project, utf8_status
from rowatlas.sources.scanner import CSV, spans


def test_projection():
    got, more = project(b'"a""b",plain,')
    assert [(f["raw_start"], f["raw_end"], f["decoded"]) for f in got] == [(0, 6, b'a"b'), (7, 12, b"plain"), (13, 13, b"")]
    assert got[0]["quoted"] and got[0]["escaped_quotes"] and not got[1]["quoted"] and not more


def test_every_kind_of_field():
    got, _ = project(b',alpha,,"a,b","line1\nline2","say ""hi""",')
    assert [f["decoded"] for f in got] == [b"", b"alpha", b"", b"a,b", b"line1\nline2", b'say "hi"', b""]
    assert [f["decoded"] for f in project(b"")[0]] == [b""]
    assert [f["decoded"] for f in project(b'"a"b"c,d')[0]] == [b'ab"c', b"d"]
    assert [f["decoded"] for f in project(b'"open, still')[0]] == [b"open, still"]


def test_bounds():
    got, more = project(b"aaaa,bbbb,cccc,dddd", CSV, Limits(3, 3, 7))
    assert more and [f["decoded"] for f in got] == [b"aaa", b"bbb", b"c"] and all(f["decoded_truncated"] for f in got)
    cut, _ = project("é,ü".encode()[:-1], CSV, truncated=True)
    assert cut[-1]["utf8_status"] == "incomplete" and cut[-1]["raw_truncated"] and not cut[0]["raw_truncated"]
    assert utf8_status(b"\xff", False) == "invalid" and utf8_status("é".encode()[:1], False) == "invalid"


def test_blocks_of_a_file_give_its_records(spark, tmp_path):
    rng = random.Random(3)
    path = str(tmp_path / "x.csv")
    data = bytes(rng.choice(b'ab,"\r\n') for _ in range(3000)) + b'"open'
    with open(path, "wb") as f:
        f.write(data)
    want = spans(data)
    for size in (97, 1 << 20):
        rows = delimited.read_records(spark, path, block_bytes=size).orderBy("row").collect()
        assert [r.row for r in rows] == list(range(len(want.spans)))
        assert [(r.start, r.end) for r in rows] == want.spans and all(bytes(r.bytes) == data[r.start : r.end] for r in rows)
        assert delimited.plan_blocks(spark, path, CSV, size)[2] == want.diagnostic


def test_data_source_and_fields(spark, tmp_path):
    path = tmp_path / "y.tsv"
    path.write_bytes(b"\xef\xbb\xbfa\t\"b\tc\"\r\n\nd\xff")
    delimited.register(spark)
    df = spark.read.format("rowdocument").load(str(path))
    got = fields.project_fields(df, delimited.dialect_of(str(path)), UNBOUNDED).orderBy("row").collect()
    assert [[bytes(f.decoded) for f in r.fields] for r in got] == [[b"\xef\xbb\xbfa", b"b\tc"], [b""], [b"d\xff"]]
    assert got[2].fields[0].utf8_status == "invalid"


def test_empty_file(spark, tmp_path):
    path = tmp_path / "e.log"
    path.write_bytes(b"")
    assert delimited.read_records(spark, str(path)).count() == 0


def test_lines_from_text(spark):
    df = spark.createDataFrame([(1, "a\r\nb\rc\n"), (2, ""), (3, None), (4, "\n\nx")], "k long, t string")
    got = [(r.k, r.line, r.value) for r in lines.line_records(df, "k", "t").orderBy("k", "line").collect()]
    assert got == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (4, 0, ""), (4, 1, ""), (4, 2, "x")]
    assert spark.range(1).select(lines.split_fields(F.lit("a,,b,")).alias("f")).first().f == ["a", "", "b", ""]


def test_format_and_path(tmp_path):
    assert [formats.infer_format(p) for p in ("a.CSV", "b.tsv", "c.NdJson", "d.log", "e.xlsx")] == ["csv", "tsv", "lines", "lines", "xlsx"]
    for bad in ("x", "x.parquet", "csv"):
        with pytest.raises(ValueError):
            formats.infer_format(bad)
    (tmp_path / "f").write_text("x")
    os.symlink(tmp_path / "f", tmp_path / "l")
    for bad in ("", "//server/x", str(tmp_path), str(tmp_path / "l")):
        with pytest.raises(ValueError):
            formats.check_path(bad)
    assert formats.check_path(str(tmp_path / "f")).st_size == 1


def test_fingerprints(spark, tmp_path):
    P = formats.Fingerprint
    cases = [
        (P(5, "a", "r"), P(9, "b", "s"), "identity_changed"), (P(5, "a", "r"), P(5, None, "r"), "evidence_lost"), (P(5, "a", "r"), P(4, "a", "s"), "shrank"),
        (P(5, "a", "r"), P(6, "a", "r"), "grew"), (P(5, "a", "r"), P(5, "a", "s"), "revision_changed"), (P(5, "a", "r"), P(5, "a", None), "evidence_lost"),
        (P(5, None, None), P(5, "a", "r"), "unchanged"), (P(5, "a", "r"), P(5, "a", "r"), "unchanged"),
    ]
    kind = "struct<size:long,identity:string,revision:string>"
    df = spark.createDataFrame([((a.size, a.identity, a.revision), (b.size, b.identity, b.revision), w) for a, b, w in cases], f"a {kind}, b {kind}, w string")
    assert all(formats.change(a, b) == w for a, b, w in cases)
    assert df.where(formats.change_column(F.col("a"), F.col("b")) != F.col("w")).count() == 0
    path = tmp_path / "g"
    path.write_text("one")
    before = P.of(str(path))
    path.write_text("two more")
    with pytest.raises(formats.SourceChanged, match="grew"):
        formats.verify(str(path), before)


def test_display(spark):
    assert render(b"bad\xfftail") == ("bad\\xFFtail", False, True)
    assert render(b"line1\nline2\t\r\0\x1b\xc2\x85") == ("line1\\nline2\\t\\r\\0\\u{1B}\\u{85}", False, False)
    text, over, _ = render(b"x" * 1025)
    assert over and len(text) == 1024 and text.endswith("x ...")
    assert render(b"abc", True)[0] == "abc ..."
    assert utf16_prefix("a😀b", 2) == "a" and utf16_prefix("a😀b", 3) == "a😀"
    assert utf8_prefix("aé", 2) == "a"
    df = spark.createDataFrame([(0, bytearray(b"a\xffb")), (1, None)], "row long, bytes binary")
    assert [r.text for r in rendered(df).orderBy("row").collect()] == ["a\\xFFb", ""]
