import json
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowatlas.functions import text as T
from rowatlas.operators import columns as C
from rowatlas.operators import find, index, rows, sort, view


def ranks(spark, keys, mode="text", descending=False):
    df = spark.createDataFrame(list(enumerate(keys)), "row long, k string")
    return [r.row for r in sort.sort_order(df, F.col("k"), mode, descending).orderBy("rank").collect()]


def test_numeric_vectors(spark):
    keys = ["18014398509481985", "18014398509481984", "-7", "5.50", "55e-1", " ", "kilo", "-0.0", "0"]
    assert ranks(spark, keys, "numeric") == [2, 7, 8, 3, 4, 1, 0, 6, 5]
    assert ranks(spark, keys, "numeric", True) == [0, 1, 3, 4, 7, 8, 2, 6, 5]
    keys = ["3e ", "3e+ ", ".25", "-.75", "4e-2", "6.", "  +0002.5e-1 "]
    assert ranks(spark, keys, "numeric") == [3, 4, 2, 6, 5, 0, 1]


def test_numeric_range(spark):
    far = "1e9223372036854775808"
    assert ranks(spark, [far + "x", "1e9223372036854775807"], "numeric") == [1, 0]
    with pytest.raises(Exception, match="out of range"):
        ranks(spark, [far, "1"], "numeric")


def test_numbers_agree_with_decimals(spark):
    rng = random.Random(1)
    keys = []
    for _ in range(300):
        s = rng.choice(["", "-", "+"]) + str(rng.randrange(10 ** rng.randrange(1, 12)))
        s += "." + "0" * rng.randrange(4) + str(rng.randrange(1000)) if rng.random() < 0.5 else ""
        keys.append(s + (f"e{rng.randrange(-30, 30)}" if rng.random() < 0.4 else ""))
    want = sorted(range(len(keys)), key=lambda k: (Decimal(keys[k]), k))
    assert ranks(spark, keys, "numeric") == want
    down = sorted(range(len(keys)), key=lambda k: (-Decimal(keys[k]), k))
    assert ranks(spark, keys, "numeric", True) == down


def test_text_is_bytes_and_stable(spark):
    df = spark.createDataFrame([(0, bytearray(b"\xff")), (1, bytearray(b"\x80")), (2, bytearray(b"a"))], "row long, k binary")
    assert [r.row for r in sort.sort_order(df, F.col("k"), "text").orderBy("rank").collect()] == [2, 1, 0]
    keys = ["b", "", "é", "Z", "b", "a"]
    assert ranks(spark, keys) == [1, 3, 5, 0, 4, 2]
    assert ranks(spark, keys, "text", True) == [2, 0, 4, 5, 3, 1]


def test_ranks_are_contiguous_over_many_ranges(spark):
    df = spark.range(10_000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("k"), "id")
    got = rows.ranked(df, [F.col("k").asc(), F.col("id").asc()], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(10_000))
    assert [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)


def test_numbers_come_from_one_exchange(spark):
    """The counts and the numbers read the same ranges, whatever else a query does with them."""
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.concat(F.lit("t"), F.col("id")).alias("t"))
    numbered = rows.with_row(df, "k")
    assert [r.row for r in numbered.orderBy("k").select("row").collect()] == list(range(5000))
    both = numbered.where("row < 10").unionByName(numbered.where("row >= 4990")).join(spark.range(5000).withColumnRenamed("id", "k"), "k")
    both.collect()
    assert sorted(r.row for r in both.collect()) == [*range(10), *range(4990, 5000)]
    numbered.collect()
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan and "InMemory" not in plan
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        with pytest.raises(ValueError):
            rows.with_row(df, "k")
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert rows.with_row(df.limit(0), "k").count() == 0


def test_places_and_first_rows(spark):
    df = spark.createDataFrame([(k * 3 % 50, f"t{k}") for k in range(50)], "k long, t string")
    window = view.viewport(rows.places(df, "k"), 7, 3)
    assert sorted((r.row, r.k) for r in rows.at(df, window, "k").collect()) == [(7, 7), (8, 8), (9, 9)]
    assert [(r.row, r.k) for r in view.first_rows(df, "k", count=3).orderBy("row").collect()] == [(0, 0), (1, 1), (2, 2)]


def test_flags_and_json(spark):
    df = spark.createDataFrame([(0, bytearray(b"a\"\n\xff")), (1, bytearray(b""))], "row long, bytes binary")
    got = [json.loads(r.json) for r in view.window_json(view.preview(df, most=3)).orderBy("row").collect()]
    assert got == [{"row": 0, "preview_utf8_lossy": 'a"\n', "preview_bytes": 3, "truncated": True}, {"row": 1, "preview_utf8_lossy": "", "preview_bytes": 0, "truncated": False}]
    assert json.loads(view.window_json(view.preview(df)).orderBy("row").first().json)["preview_utf8_lossy"] == 'a"\n\ufffd'
    assert view.any_flags(view.preview(df, most=3), "truncated").first().any_truncated and not view.any_flags(view.preview(df).limit(0), "truncated").first().any_truncated


def test_first_page_is_the_start_of_the_order(spark):
    df = spark.range(500).select(F.col("id").alias("row"), (F.col("id") % 7).cast("string").alias("k"))
    page = sort.first_page(df, F.col("k"), "numeric", True, 20)
    order = sort.sort_order(df, F.col("k"), "numeric", True)
    assert sorted(page.collect()) == sorted(view.viewport(order, 0, 20, "rank").collect())
    assert "TakeOrderedAndProject" in page._jdf.queryExecution().toString()


def test_requests():
    r = sort.next_request(None, 2)
    assert r == sort.Request(1) and sort.next_request(r, 2).descending and not sort.next_request(sort.next_request(r, 2), 2).descending
    assert sort.next_request(sort.Request(1, "numeric", True), 3) == sort.Request(2) and sort.next_request(r, 0) is None
    assert sort.next_request(sort.Request(1, "numeric"), 2) == sort.Request(1, "numeric", True)


def test_hits_overlap_and_are_bytes(spark):
    df = spark.createDataFrame([(0, "aaaa"), (1, "éaa"), (2, 'x"y.z'), (3, None)], "row long, t string")
    got = [tuple(r) for r in find.hits(df, F.col("t"), "aa").orderBy("row", "start").collect()]
    assert got == [(0, 0, 2), (0, 1, 3), (0, 2, 4), (1, 2, 4)]
    assert [r[0] for r in df.select(find.hit_count(F.col("t"), "aa")).collect()] == [3, 1, 0, None]
    assert [r[0] for r in df.select(find.hit_count(F.col("t"), ".")).collect()][2] == 1
    with pytest.raises(ValueError):
        find.matching(df, F.col("t"), "")


def test_hits_take_time_in_proportion(spark):
    import time

    def spent(n):
        df = spark.range(1).select(F.lit(0).alias("row"), F.repeat(F.lit("éab"), n).alias("t"))
        began = time.perf_counter()
        got = find.hits(df, F.col("t"), "ab").agg(F.count("*"), F.max("start"), F.sum("start")).first()
        assert tuple(got) == (n, 4 * n - 2, sum(4 * k + 2 for k in range(n)))
        return time.perf_counter() - began

    spent(1000)
    assert spent(160_000) < 8 * spent(40_000) + 1


def test_hits_on_demand_and_counts(spark):
    df = spark.createDataFrame([(k, 1, "ab" * (k % 4)) for k in range(40)], "a long, b int, t string")
    want = [(k, 1, 2 * j, 2 * j + 2) for k in range(40) for j in range(k % 4)]
    for n in (1, 4, 100):
        first = find.first_hits(df, F.col("t"), "ab", n, keys=("a", "b"))
        assert [tuple(r) for r in first.collect()] == want[:n]
        assert "TakeOrderedAndProject" in first._jdf.queryExecution().toString() and "rangepartitioning" not in first._jdf.queryExecution().toString()
    assert tuple(find.search_counts(df, F.col("t"), "AB", False).first()) == (40, 30, 60)
    assert tuple(find.search_counts(df.limit(0), F.col("t"), "ab").first()) == (0, 0, 0)


def test_case_folds_ascii_only(spark):
    df = spark.createDataFrame([(0, "needle\ninside"), (1, "NEEDLE\ninSIDE"), (2, "É")], "row long, t string")
    assert [r.row for r in find.matching(df, F.col("t"), "needle\nINSIDE", False).orderBy("row").collect()] == [0, 1]
    assert find.matching(df, F.col("t"), "é", False).count() == 0


def test_hit_pages_steps_and_quota(spark):
    df = spark.createDataFrame([(k, "x") for k in range(3)], "row long, t string")
    held = find.numbered(find.hits(df, F.col("t"), "x"))
    status = find.quota_status(held, 48 + 24 * 3 - 1).first()
    assert (status.stored, status.exceeded, status.required, status.rejected_row) == (2, True, 120, 2)
    assert not find.quota_status(held, 48 + 24 * 3).first().exceeded
    assert find.stored(held, 48 + 24 * 3 - 1).count() == 2
    assert find.step(held, None).first().hit == 0 and find.step(held, None, False).first().hit == 2
    assert find.step(held, 2).count() == 0 and find.step(held, 0, False).count() == 0
    assert find.page(held, 1, 2).count() == 2 and find.page(held, 2, 2).count() == 1


def test_windows_of_rows():
    w = view.RowWindow(1000, 128)
    assert w.seek(990).first == 872 and w.center(500).first == 436 and w.seek(10).scroll(-50).first == 0 and w.scroll(1 << 70).first == 872
    assert w.seek(990).absolute(127) == 999 and w.absolute(128) is None
    assert view.RowWindow(3, 128).seek(2).first == 0
    assert view.parse_row("1") == 0 and view.parse_row("18446744073709551615") == (1 << 64) - 2
    for bad in ("", "0", "1a", "-1", "18446744073709551616", "١"):
        with pytest.raises(ValueError):
            view.parse_row(bad)


def test_previews(spark):
    df = spark.createDataFrame([(0, "é" * 3000), (1, "abc"), (2, "")], "row long, bytes string")
    got = view.preview(df).orderBy("row").collect()
    assert [(len(r.preview), r.truncated) for r in got] == [(4096, True), (3, False), (0, False)]
    cut = view.within_payload(view.preview(df), 4098).orderBy("row").collect()
    assert [(len(r.preview), r.truncated) for r in cut] == [(4096, True), (2, True), (0, False)]
    assert view.reached_end(df, 0).first().reached_eof and not view.reached_end(df, 0, 2).first().reached_eof


def test_columns():
    c = C.Columns(3)
    assert c.hide(2).visible() == [1, 3] and not c.can_hide(0) and not c.can_hide(4) and not c.hide(2).can_hide(2)
    assert c.hide(1).hide(2).hide(3).visible() == [3] and c.hide(1).show_all() == c
    assert c.hide(1).file_column(1) == 2 and c.hide(1).file_column(0) == 0 and c.hide(1).shown_place(3) == 2 and c.hide(1).shown_place(1) is None
    assert C.titles("cells", 28)[-2:] == ["AA", "AB"] and C.titles("preview", 1) == ["Preview"] and len(C.titles("fields", 99)) == 64


def test_copy(spark):
    df = spark.createDataFrame([(1, ["b", ""]), (0, ["a", "c"])], "row long, f array<string>")
    assert C.copy_text(C.copy_lines(df, F.col("f"))).first().text == "1\ta\tc\r\n2\tb\t"
    many = spark.range(4097).select(F.col("id").alias("row"), F.array(F.lit("x")).alias("f"))
    with pytest.raises(ValueError):
        C.copy_text(C.copy_lines(many, F.col("f")))
    wide = spark.createDataFrame([(0, ["x" * (1 << 19)])], "row long, f array<string>")
    with pytest.raises(ValueError):
        C.copy_text(C.copy_lines(wide, F.col("f")))


def test_checkpoints(spark):
    for capacity, stride, n in ((2, 1, 1), (2, 1, 3), (4, 3, 40), (8, 4, 1000), (5, 2, 17)):
        entries, s = [0], stride
        for row in range(1, n):
            if len(entries) == capacity:
                entries, s = entries[::2], s * 2
            if row - entries[-1] >= s:
                entries.append(row)
        df = spark.range(n).select(F.col("id").alias("row"), (F.col("id") * 10).alias("offset"))
        got = [r.row for r in index.row_index(df, capacity, stride).orderBy("row").collect()]
        assert index.row_stride(n, capacity, stride) == s or len(entries) < capacity
        assert got == [r for r in range(0, n, index.row_stride(n, capacity, stride))]
    df = spark.range(100).select(F.col("id").alias("row"), (F.col("id") * 10 + F.col("id") % 3).alias("offset"))
    by = index.byte_index(df, 8, 16).orderBy("row").collect()
    assert by[0] == (0, 0) and len(by) <= 8 and index.nearest(index.byte_index(df, 8, 16), by[2].row + 1).first() == by[2]
    with pytest.raises(ValueError):
        index.ByteCheckpoints(1, 5)


def test_byte_checkpoints_are_taken_one_record_at_a_time():
    rng = random.Random(7)
    for capacity, stride, n in ((2, 1, 50), (3, 20, 400), (8, 64, 3000), (5, 7, 1)):
        offsets = [0]
        for _ in range(n - 1):
            offsets.append(offsets[-1] + rng.randrange(1, 60))
        entries, step = [0], stride
        for k in range(1, n):  # record by record
            if len(entries) == capacity:
                entries, step = entries[::2], step * 2
            if offsets[k] - offsets[entries[-1]] >= step:
                entries.append(k)
        index_ = index.ByteCheckpoints(capacity, stride)
        for at in range(0, n, 37):
            index_.take(np.arange(at, min(n, at + 37)), np.array(offsets[at : at + 37]))
        assert index_.rows == entries and index_.offsets == [offsets[k] for k in entries]
    with pytest.raises(ValueError):
        index_.take(np.array([0]), np.array([5]))


def test_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert [get(T.column_letters(F.lit(n))) for n in (1, 26, 27, 702, 703, 16384)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert [get(T.size_text(F.lit(n).cast("long"))) for n in (0, 1, 1 << 20, (1 << 30) + 1)] == ["0 MB", "1 MB", "1 MB", "1.1 GB"]
    assert get(T.escape_display(F.lit("a\nb\t\r\0\x1b\x85é"))) == "a\\nb\\t\\r\\0\\u{1B}\\u{85}é"
    assert get(T.ascii_lower(F.lit("AÉz"))) == "aÉz"
