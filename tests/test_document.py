import pytest
from pyspark.sql import functions as F

from rowatlas.operators import sort
from rowatlas.plans import catalog
from rowatlas.plans.document import Document
from rowatlas.streaming import progress


def test_open_sort_find_and_show(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes(b'k,v\n10,"b ""x"""\n9,a\n,\xff\n')
    doc = Document.open(spark, str(path))
    assert doc.count() == 4
    text = doc.sort(sort.Request(0))
    assert [r.row for r in text.orderBy("rank").collect()] == [3, 1, 2, 0]
    number = doc.sort(sort.Request(0, "numeric", True))
    assert [r.row for r in number.orderBy("rank").collect()] == [1, 2, 0, 3]
    assert [r.row for r in doc.sorted_viewport(number, 0, 2).orderBy("rank").collect()] == [1, 2]
    hits = doc.find('"x', F.col("bytes").cast("string")).collect()
    assert [(r.row, r.start) for r in hits] == [(1, 7)]
    assert doc.go_to("3").first().row == 2
    hidden = doc.hide(1).shown().orderBy("row").collect()
    assert bytes(hidden[2].fields[1]) == b"a" and bytes(hidden[2].fields[0] or b"") == b""
    assert doc.checkpoints(2, 1).count() <= 2


def test_table_document(spark):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 5)], "k long, x string, n int")
    doc = Document.from_table(df, ["k"], ["x", "n"])
    assert [r.fields for r in doc.viewport(0).orderBy("row").collect()] == [["a", "5"], ["b", ""]]
    assert doc.width().first().width == 2 and doc.titles() == ["Column 1", "Column 2"]


def test_workbooks_are_not_sorted(spark):
    doc = Document(spark, spark.createDataFrame([(0, ["a"])], "row long, fields array<string>"), "cells")
    for f in (lambda: doc.sort(sort.Request(0)), lambda: doc.find("a", F.lit("a"))):
        with pytest.raises(ValueError):
            f()


def test_generations(spark):
    g = progress.Generations(spark, "t")
    with g.newest() as one:
        assert spark.range(10).count() == 10 and not g.cancelled(one)
    with g.newest() as two:
        assert g.cancelled(one) and not g.cancelled(two)
    g.cancel()
    assert g.cancelled(two) and progress.progress(spark) == []


def test_follow_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("x\nyy\n")
    stream = progress.follow_lines(spark, str(tmp_path / "in"))
    q = progress.counted(stream).writeStream.outputMode("complete").format("memory").queryName("followed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.records, r.payload_bytes) for r in spark.table("followed").collect()] == [(2, 3)]


def test_catalog_is_whole():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 35


def test_core_does_not_need_the_llm_folder():
    import subprocess
    import sys

    code = "import sys; sys.modules['rowatlas.llm']=None; from rowatlas.plans import catalog, document; from rowatlas.sources import xlsx; assert not any(m.startswith('rowatlas.llm.') for m in sys.modules); print('ok')"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True).stdout.strip() == "ok"
