"""The registered queries of the row-document engine and their DuckDB counterparts.

Each runs one operator over a whole table. Source order is the table's key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowatlas.functions import text as T
from rowatlas.operators import columns as C
from rowatlas.operators import find, index, rows, sort, view
from rowatlas.plans import files
from rowatlas.plans.document import summary_json
from rowatlas.sources import delimited, display, fields, lines, xlsx
from rowatlas.sources.scanner import CSV, TSV
from rowatlas.streaming.progress import counted

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _rows(spark: SparkSession, sf_dir: str, name: str, *columns: str, keys: int = 1) -> DataFrame:
    return rows.with_row(_table(spark, sf_dir, name, *columns), *columns[:keys])


def _cents(column: str):
    """A price as text, made from a whole number so that every engine writes it alike."""
    return F.round(F.col(column) * 100).cast("long").cast("string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by price as exact numbers in text, descending: the first window of ranks with its rows."""
    orders = rows.with_row(_table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", _cents("o_totalprice").alias("price")), "o_orderkey")
    return sort.sorted_viewport(sort.first_page(orders, F.col("price"), "numeric", True), orders, 0).select("rank", "row", "o_orderkey", "price")


@query("""WITH r AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS p, row_number() OVER (ORDER BY o_orderkey) - 1 AS "row" FROM orders),
k AS (SELECT *, row_number() OVER (ORDER BY p DESC, "row") - 1 AS rank FROM r)
SELECT rank, "row", o_orderkey, p::VARCHAR AS price FROM k WHERE rank < 128""")
def sorted_first_page(spark, d):
    return flagship(spark, d)


@query("SELECT count(*) AS records FROM lineitem")
def record_count(spark, d):
    return _table(spark, d, "lineitem").agg(F.count("*").alias("records"))


@query("""SELECT "row", o_orderkey, o_orderstatus FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS "row" FROM orders) WHERE "row" BETWEEN 700 AND 827""")
def viewport_rows(spark, d):
    t = _table(spark, d, "orders", "o_orderkey", "o_orderstatus")
    return rows.at(t, view.viewport(rows.places(t, "o_orderkey"), 700), "o_orderkey").select("row", "o_orderkey", "o_orderstatus")


@query("""SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS "row", o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 128""")
def first_viewport(spark, d):
    return view.first_rows(_table(spark, d, "orders", "o_orderkey", "o_orderstatus"), "o_orderkey").select("row", "o_orderkey", "o_orderstatus")


@query("""SELECT "row", '{"row":' || "row" || ',"preview_utf8_lossy":"' || n_name || '","preview_bytes":' || strlen(n_name) || ',"truncated":false}' AS json FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS "row" FROM nation) WHERE "row" BETWEEN 5 AND 132""")
def viewport_json(spark, d):
    return view.window_json(view.preview(view.viewport(_rows(spark, d, "nation", "n_nationkey", "n_name"), 5), "n_name"))


@query("SELECT coalesce(bool_or(strlen(text) > 4096), false) AS any_truncated, false AS any_invalid FROM documents")
def any_flags(spark, d):
    cut = view.preview(_table(spark, d, "documents", "text"), "text").withColumn("invalid", ~F.is_valid_utf8("text"))
    return view.any_flags(cut, "truncated", "invalid")


@query("""SELECT "row", n_nationkey, n_name FROM (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS "row" FROM nation) WHERE "row" >= 1000""")
def viewport_past_eof(spark, d):
    return view.viewport(_rows(spark, d, "nation", "n_nationkey", "n_name"), 1000).select("row", "n_nationkey", "n_name")


@query("SELECT count(*) - 1 < 128 AS reached_eof FROM nation")
def viewport_reached_eof(spark, d):
    return view.reached_end(_rows(spark, d, "nation", "n_nationkey"), 0)


@query("""SELECT "row", p_partkey, p_name FROM (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS "row" FROM part) WHERE "row" = 122""")
def goto_row(spark, d):
    t = _table(spark, d, "part", "p_partkey", "p_name")
    return rows.at(t, view.viewport(rows.places(t, "p_partkey"), view.parse_row("123"), 1), "p_partkey").select("row", "p_partkey", "p_name")


@query("""SELECT doc_id, least(strlen(text), 4096) AS preview_bytes, strlen(text) > 4096 AS truncated, md5(encode(text)[1:4096]) AS preview_md5 FROM documents""")
def row_preview_truncated(spark, d):
    cut = view.preview(_table(spark, d, "documents", "doc_id", "text"), "text")
    return cut.select("doc_id", F.octet_length("preview").cast("long").alias("preview_bytes"), "truncated", F.md5("preview").alias("preview_md5"))


_LINES = r"""WITH p AS (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS parts FROM documents),
l AS (SELECT doc_id, unnest(CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END) AS value, generate_subscripts(CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END, 1) - 1 AS line FROM p)"""


@query(_LINES + " SELECT doc_id, line, value FROM l")
def line_records(spark, d):
    return lines.line_records(_table(spark, d, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id", F.col("line").cast("long").alias("line"), "value")


# No text of the tables holds a quote; what quotes do is checked by the csv_ queries.
@query("""SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), ',')) AS field, generate_subscripts(string_split(coalesce(text, ''), ','), 1) - 1 AS ordinal FROM conversations""")
def split_fields(spark, d):
    t = _table(spark, d, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.lit(0).cast("long").alias("start"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    cut = fields.project_fields(t, CSV, fields.UNBOUNDED).select("conv_id", "turn", F.explode("fields").alias("f"))
    return cut.select("conv_id", "turn", F.col("f.decoded").cast("string").alias("field"), F.col("f.ordinal").cast("long").alias("ordinal"))


def _records(spark, paths: list[str], dialect: str) -> DataFrame:
    delimited.register(spark)
    return spark.read.format("rowdocument").option("dialect", dialect).load(",".join(paths))


def _cell(k: int):
    return F.col("fields")[k]["decoded"].cast("string")


@query("""SELECT c_custkey, c_name || ',"x"' || chr(10) || c_mktsegment AS note, c_nationkey::VARCHAR AS nation, true AS quoted, true AS escaped, false AS bare_quoted, 3 AS n_fields FROM customer""")
def csv_fields(spark, d):
    """Quoted delimiters, quotes and line ends, through files and back."""
    t = _table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    note = F.concat(F.col("c_name"), F.lit(',"x"\n'), F.col("c_mktsegment"))
    paths = files.write_records(t.select(F.concat_ws(",", files.quoted(F.col("c_custkey").cast("string")), files.quoted(note), F.col("c_nationkey").cast("string"))), "csv")
    read = fields.project_fields(_records(spark, paths, "csv"), CSV, fields.UNBOUNDED)
    f = F.col("fields")
    return read.select(_cell(0).cast("long").alias("c_custkey"), _cell(1).alias("note"), _cell(2).alias("nation"), f[0]["quoted"].alias("quoted"), f[1]["escaped_quotes"].alias("escaped"), f[2]["quoted"].alias("bare_quoted"), F.size(f).alias("n_fields"))


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS "row", p_partkey || ',"' || p_name || chr(10) || 'of ' || p_partkey || '"' AS record, p_name || chr(10) || 'of ' || p_partkey AS name FROM part)
SELECT "row", p_partkey::VARCHAR AS key, name, (sum(strlen(record) + 1) OVER (ORDER BY p_partkey) - strlen(record) - 1)::BIGINT AS start, (sum(strlen(record) + 1) OVER (ORDER BY p_partkey) - 1)::BIGINT AS "end" FROM r""")
def csv_blocks(spark, d):
    """One file in many blocks, with line ends inside of quotes: rows, places and fields."""
    t = _table(spark, d, "part", "p_partkey", "p_name").orderBy("p_partkey")
    key = F.col("p_partkey").cast("string")
    (path,) = files.write_records(t.select(F.concat_ws(",", key, files.quoted(F.concat(F.col("p_name"), F.lit("\nof "), key)))), "csv-blocks", one=True)
    read = fields.project_fields(delimited.read_records(spark, path, CSV, 16 << 10), CSV, fields.UNBOUNDED)
    return read.select("row", _cell(0).alias("key"), _cell(1).alias("name"), "start", "end")


@query("""SELECT n_nationkey::VARCHAR AS key, n_name || ', ' || n_regionkey AS name, 2 AS n_fields FROM nation""")
def tsv_fields(spark, d):
    t = _table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    paths = files.write_records(t.select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), F.concat_ws(", ", F.col("n_name"), F.col("n_regionkey").cast("string")))), "tsv")
    return fields.project_fields(_records(spark, paths, "tsv"), TSV, fields.UNBOUNDED).select(_cell(0).alias("key"), _cell(1).alias("name"), F.size("fields").alias("n_fields"))


@query(r"""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'invalid' ELSE 'valid' END AS utf8_status, CASE WHEN s_suppkey % 2 = 0 THEN '\xFF' || s_name || '\xC3' ELSE s_name END AS shown, s_suppkey % 2 = 0 AS escaped_non_utf8 FROM supplier""")
def csv_bad_bytes(spark, d):
    """Bytes that are no UTF-8, through files, fields and display text."""
    t = _table(spark, d, "supplier", "s_suppkey", "s_name")
    bad = F.col("s_suppkey") % 2 == 0
    raw = F.concat(F.concat(F.col("s_suppkey").cast("string"), F.lit(",")).cast("binary"), F.when(bad, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))), F.col("s_name").cast("binary"), F.when(bad, F.unhex(F.lit("C3"))).otherwise(F.unhex(F.lit(""))))
    read = fields.project_fields(_records(spark, files.write_records(t.select(raw.cast("string")), "bad-bytes"), "csv"), CSV, fields.UNBOUNDED)
    cells = read.select(_cell(0).cast("long").alias("row"), F.col("fields")[1]["decoded"].alias("raw"), F.col("fields")[1]["utf8_status"].alias("utf8_status"))
    shown = display.rendered(cells, "raw").select("row", F.col("text").alias("shown"), "escaped_non_utf8")
    return cells.select("row", "utf8_status").join(shown, "row").withColumnRenamed("row", "s_suppkey")


@query("""SELECT 'unterminated_quoted_field' AS kind, (sum(strlen(r_regionkey || ',' || r_name) + 1) + strlen('9,"open') + 1 + strlen('to the end') + 1)::BIGINT AS at, sum(strlen(r_regionkey || ',' || r_name) + 1)::BIGINT AS record_start FROM region""")
def csv_open_quote(spark, d):
    """A quote that is never closed: where the file ends, and where its record starts."""
    t = _table(spark, d, "region", "r_regionkey", "r_name").select(F.col("r_regionkey").alias("k"), F.concat_ws(",", F.col("r_regionkey").cast("string"), F.col("r_name")).alias("value"))
    last = spark.range(1).select(F.lit(1 << 40).alias("k"), F.lit('9,"open\nto the end').alias("value"))
    (path,) = files.write_records(t.unionByName(last).orderBy("k").select("value"), "open-quote", one=True)
    return spark.createDataFrame([delimited.diagnostic(spark, path, CSV)], "kind string, at long, record_start long")


@query("SELECT event_id || ':' || props AS value, strlen(event_id || ':' || props) AS size FROM events")
def file_lines(spark, d):
    """JSON Lines files and the like: plain lines, quotes and all."""
    t = _table(spark, d, "events", "event_id", "props")
    read = _records(spark, files.write_records(t.select(F.concat_ws(":", F.col("event_id").cast("string"), F.col("props"))), "lines"), "lines")
    return read.select(F.col("bytes").cast("string").alias("value"), (F.col("end") - F.col("start")).alias("size"))


@query(_LINES + " SELECT least(max(len(string_split(value, ','))), 64) AS width FROM l")
def field_width(spark, d):
    held = lines.line_records(_table(spark, d, "documents", "doc_id", "text"), "doc_id", "text").select(lines.split_fields(F.col("value")).alias("fields"))
    return held.agg(rows.width(F.col("fields")).cast("long").alias("width"))


def _order_sql(table: str, key: str, by: str, order: str) -> str:
    return f"""WITH r AS (SELECT {key} AS k, row_number() OVER (ORDER BY {by}) - 1 AS "row" FROM {table})
SELECT row_number() OVER (ORDER BY {order}, "row") - 1 AS rank, "row" FROM r"""


@query(_order_sql("customer", "c_name", "c_custkey", "k"))
def sort_text_asc(spark, d):
    return sort.sort_order(_rows(spark, d, "customer", "c_custkey", "c_name"), F.col("c_name"))


@query(_order_sql("part", "p_name", "p_partkey", "k DESC"))
def sort_text_desc(spark, d):
    return sort.sort_order(_rows(spark, d, "part", "p_partkey", "p_name"), F.col("p_name"), descending=True)


@query(_order_sql("part", "p_size", "p_partkey", "k"))
def sort_numeric_asc(spark, d):
    return sort.sort_order(_rows(spark, d, "part", "p_partkey", "p_size"), F.col("p_size").cast("string"), "numeric")


@query(_order_sql("part", "p_size", "p_partkey", "k DESC"))
def sort_numeric_desc(spark, d):
    return sort.sort_order(_rows(spark, d, "part", "p_partkey", "p_size"), F.col("p_size").cast("string"), "numeric", True)


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 2 WHEN event_id % 5 = 1 THEN 1 ELSE 0 END AS g, event_type AS t,
  CASE WHEN event_id % 5 = 2 THEN -(event_id % 97)::DECIMAL(20, 2) ELSE (event_id % 89)::DECIMAL(20, 2) / 4 END AS v, row_number() OVER (ORDER BY event_id) - 1 AS "row" FROM events)
SELECT row_number() OVER (ORDER BY g, CASE WHEN g = 0 THEN v END DESC, CASE WHEN g = 1 THEN t END DESC, "row") - 1 AS rank, "row" FROM r""")
def sort_numeric_mixed(spark, d):
    e = _rows(spark, d, "events", "event_id", "event_type")
    quarter = F.concat(F.floor(F.col("event_id") % 89 / 4).cast("string"), F.element_at(F.array(*map(F.lit, ("", ".25", ".50", ".75"))), (F.col("event_id") % 89 % 4 + 1).cast("int")))
    key = F.when(F.col("event_id") % 5 == 0, "  ").when(F.col("event_id") % 5 == 1, F.col("event_type")).when(F.col("event_id") % 5 == 2, F.concat(F.lit("-"), (F.col("event_id") % 97).cast("string"), F.lit("e0"))).otherwise(quarter)
    return sort.sort_order(e, key, "numeric", True)


@query(_order_sql("lineitem", "l_shipdate", "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate", "strftime(k, '%Y-%m-%d %H:%M:%S')"))
def sort_lineitem(spark, d):
    names = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    return sort.sort_order(_rows(spark, d, "lineitem", *names, keys=len(names)), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))


_RANKS = """WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS "row" FROM orders),
k AS (SELECT *, row_number() OVER (ORDER BY o_orderpriority DESC, "row") - 1 AS rank FROM r) """


def _orders(spark, d):
    held = _rows(spark, d, "orders", "o_orderkey", "o_orderpriority")
    return held, sort.sort_order(held, F.col("o_orderpriority"), descending=True)


@query(_RANKS + """SELECT rank, "row" FROM k WHERE "row" = 77""")
def rank_of_row(spark, d):
    return sort.rank_of(_orders(spark, d)[1], 77)


@query(_RANKS + """SELECT rank, "row" FROM k WHERE rank = 1000""")
def row_at_rank(spark, d):
    return sort.row_at(_orders(spark, d)[1], 1000)


@query(_RANKS + """SELECT rank, "row", o_orderkey, o_orderpriority FROM k WHERE rank BETWEEN 256 AND 383""")
def sorted_viewport(spark, d):
    held, order = _orders(spark, d)
    return sort.sorted_viewport(order, held, 256).select("rank", "row", "o_orderkey", "o_orderpriority")


@query("""SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS "row", n_name FROM nation""")
def sort_restore_source(spark, d):
    return _rows(spark, d, "nation", "n_nationkey", "n_name").select("row", "n_name").orderBy("row")


@query("SELECT doc_id FROM documents WHERE contains(text, 'the that')")
def find_exact(spark, d):
    return find.matching(_table(spark, d, "documents", "doc_id", "text"), F.col("text"), "the that").select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'licensed under')")
def find_ci(spark, d):
    return find.matching(_table(spark, d, "documents", "doc_id", "text"), F.col("text"), "LICENSED under", False).select("doc_id")


def _hits_sql(table: str, key: str, text: str, needle: str) -> str:
    n = len(needle)
    return f"""WITH t AS (SELECT row_number() OVER (ORDER BY {key}) - 1 AS "row", {text} AS x FROM {table}),
h AS (SELECT "row", x, unnest(list_filter(range(1, length(x) - {n} + 2), lambda i: substr(x, i, {n}) = '{needle}')) AS i FROM t WHERE contains(x, '{needle}')),
s AS (SELECT "row", strlen(substr(x, 1, i - 1)) AS start FROM h),
o AS (SELECT "row", start, start + {len(needle.encode())} AS "end", row_number() OVER (ORDER BY "row", start) - 1 AS hit FROM s) """


def _placed(table: DataFrame, text: str, needle: str, *keys: str) -> DataFrame:
    """Hits by row: texts are searched where they are scanned, and only the keys of a table are numbered."""
    return find.hits(table, F.col(text), needle, keys=keys).join(rows.places(table, *keys), list(keys)).select("row", "start", "end")


@query(_hits_sql("documents", "doc_id", "text", "enen") + """SELECT "row", start, "end" FROM o""")
def find_hits_overlapping(spark, d):
    return _placed(_table(spark, d, "documents", "doc_id", "text"), "text", "enen", "doc_id")


@query(_hits_sql("documents", "doc_id", "text", "enen") + """SELECT doc_id, start, "end" FROM o JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS "row" FROM documents) USING ("row") WHERE hit < 5""")
def find_first(spark, d):
    return find.first_hits(_table(spark, d, "documents", "doc_id", "text"), F.col("text"), "enen", 5, keys=("doc_id",))


@query("SELECT count(*) AS examined, count(*) FILTER (contains(text, 'tion')) AS matching, sum((length(text) - length(replace(text, 'tion', ''))) // 4)::BIGINT AS hits FROM conversations")
def search_counts(spark, d):
    return find.search_counts(_table(spark, d, "conversations", "text"), F.col("text"), "tion")


@query("SELECT sum((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS hits FROM documents")
def find_hit_count(spark, d):
    return _table(spark, d, "documents", "text").agg(F.sum(find.hit_count(F.col("text"), "the")).alias("hits"))


def _conversation_hits(spark, d):
    return find.numbered(_placed(_table(spark, d, "conversations", "conv_id", "turn", "text"), "text", "tion", "conv_id", "turn"))


_TION = _hits_sql("conversations", "conv_id, turn", "text", "tion")


@query(_TION + """SELECT hit, "row", start, "end" FROM o WHERE hit BETWEEN 256 AND 511""")
def find_page(spark, d):
    return find.page(_conversation_hits(spark, d), 300).select("hit", "row", "start", "end")


@query(_TION + """SELECT hit, "row", start, lag(hit) OVER (ORDER BY hit) AS previous, lead(hit) OVER (ORDER BY hit) AS "next" FROM o""")
def find_next_prev(spark, d):
    return find.neighbours(_conversation_hits(spark, d)).select("hit", "row", "start", "previous", "next")


@query(_TION + """SELECT hit, "row", start FROM o WHERE hit = 42 UNION ALL (SELECT hit, "row", start FROM o ORDER BY hit DESC LIMIT 1)""")
def find_step(spark, d):
    held = _conversation_hits(spark, d)
    return find.step(held, 41).unionByName(find.step(held, None, False)).select("hit", "row", "start")


_PROPS = _hits_sql("events", "event_id", "props", "7")


@query(_PROPS + """SELECT count(*) FILTER (hit < 40) AS stored, count(*) > 40 AS exceeded, CASE WHEN count(*) > 40 THEN 48 + 24 * 41 END::BIGINT AS required, max("row") FILTER (hit = 40) AS rejected_row FROM o""")
def find_quota(spark, d):
    held = find.numbered(_placed(_table(spark, d, "events", "event_id", "props"), "props", "7", "event_id"))
    return find.quota_status(held, 48 + 24 * 40 + 23)


@query(_hits_sql("orders", "o_orderkey", "o_orderpriority", "URGENT") + """, r AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS "row", o_orderpriority FROM orders),
k AS (SELECT "row", row_number() OVER (ORDER BY o_orderpriority DESC, "row") - 1 AS rank FROM r)
SELECT "row", start, rank FROM o JOIN k USING ("row")""")
def find_reveal_rank(spark, d):
    held, order = _orders(spark, d)
    return find.revealed(find.hits(held, F.col("o_orderpriority"), "URGENT"), order).select("row", "start", "rank")


@query("""SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS "row", c_custkey, c_mktsegment FROM customer""")
def hide_columns(spark, d):
    names = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    return C.shown(_rows(spark, d, "customer", *names), names, C.Columns(4).hide(2).hide(3))


@query("""SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS "row", c_custkey::VARCHAR AS a, '' AS b, c_mktsegment AS c FROM customer""")
def hide_blank_fields(spark, d):
    held = _rows(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment").withColumn("f", F.array(F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")))
    cut = held.select("row", C.blank_hidden(F.col("f"), C.Columns(3).hide(2)).alias("f"))
    return cut.select("row", F.col("f")[0].alias("a"), F.col("f")[1].alias("b"), F.col("f")[2].alias("c"))


@query("SELECT i AS ordinal, 'Column ' || i AS title FROM range(1, 65) AS r(i)")
def column_titles(spark, d):
    return spark.createDataFrame([(k, t) for k, t in enumerate(C.titles("fields", 80), 1)], "ordinal long, title string")


@query(r"SELECT doc_id, replace(replace(replace(text, chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS shown FROM documents")
def display_escape(spark, d):
    return _table(spark, d, "documents", "doc_id", "text").select("doc_id", T.escape_display(F.col("text")).alias("shown"))


@query(r"""WITH e AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS "row", replace(text, chr(10), '\n') AS x FROM documents)
SELECT "row", CASE WHEN length(x) > 1024 THEN substr(x, 1, 1020) || ' ...' ELSE x END AS text, false AS source_truncated, length(x) > 1024 AS display_truncated, false AS escaped_non_utf8 FROM e""")
def display_bounded(spark, d):
    t = _table(spark, d, "documents", "doc_id", "text")
    return display.rendered(t.join(rows.places(t, "doc_id"), "doc_id"), "text")


@query("""SELECT string_agg(n || chr(9) || r_regionkey || chr(9) || r_name, chr(13) || chr(10) ORDER BY n) AS text FROM (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS n FROM region)""")
def copy_tsv(spark, d):
    held = _rows(spark, d, "region", "r_regionkey", "r_name")
    return C.copy_text(C.copy_lines(held, F.array(F.col("r_regionkey").cast("string"), F.col("r_name"))))


_OFFSETS = """WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS "row", coalesce(sum(strlen(o_orderstatus) + strlen(o_orderpriority) + 2) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM orders),
n AS (SELECT count(*) AS n FROM orders),
s AS (SELECT min(4 * 2**k)::BIGINT AS stride FROM n, range(0, 40) AS r(k) WHERE n - 1 <= 7 * 4 * 2**k) """


def _offsets(spark, d):
    """Orders as records of text with their byte offsets: sums inside ranges, then over ranges."""
    held = _rows(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").select("row", (F.octet_length("o_orderstatus") + F.octet_length("o_orderpriority") + 2).alias("n"))
    held = held.withColumn("block", F.floor(F.col("row") / 65536))
    total = held.groupBy("block").agg(F.sum("n").alias("t"))
    before = total.select("block", (F.sum("t").over(Window.orderBy("block")) - F.col("t")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("row")) - F.col("n")
    return held.withColumn("inside", inside).join(before, "block").select("row", (F.col("before") + F.col("inside")).alias("offset"))


@query(_OFFSETS + """SELECT "row", "offset" FROM o, s WHERE "row" % stride = 0""")
def checkpoint_index(spark, d):
    return index.row_index(_offsets(spark, d), 8, 4)


@query(_OFFSETS + """SELECT "row", "offset" FROM o, s WHERE "row" % stride = 0 AND "row" <= 777 ORDER BY "row" DESC LIMIT 1""")
def checkpoint_lookup(spark, d):
    return index.nearest(index.row_index(_offsets(spark, d), 8, 4), 777)


@query(_OFFSETS.replace("WITH o AS (", "WITH RECURSIVE o AS MATERIALIZED (").rstrip() + """,
c AS (SELECT [0::BIGINT] AS rs, [0::BIGINT] AS os, 256::BIGINT AS stride, 0::BIGINT AS seen, false AS done
  UNION ALL
  SELECT CASE WHEN r IS NULL THEN rs ELSE list_append(rs, r) END, CASE WHEN r IS NULL THEN os ELSE list_append(os, f) END, stride, coalesce(r, seen), r IS NULL FROM (
    SELECT *, (SELECT min("row") FROM o WHERE "row" > seen AND "offset" >= os[-1] + stride) AS r, (SELECT min("offset") FROM o WHERE "row" > seen AND "offset" >= os[-1] + stride) AS f FROM (
      SELECT CASE WHEN thin THEN list_filter(rs, lambda x, i: i % 2 = 1) ELSE rs END AS rs, CASE WHEN thin THEN list_filter(os, lambda x, i: i % 2 = 1) ELSE os END AS os, CASE WHEN thin THEN 2 * stride ELSE stride END AS stride, seen FROM (
        SELECT *, len(rs) = 64 AND seen < (SELECT max("row") FROM o) AS thin FROM c WHERE NOT done))))
SELECT unnest(rs) AS "row", unnest(os) AS "offset" FROM c WHERE done""")
def checkpoint_byte_index(spark, d):
    return index.byte_index(_offsets(spark, d), 64, 256)


@query("SELECT 'seek' AS move, greatest(0, least(1990, count(*) - 128)) AS first FROM part UNION ALL SELECT 'center', greatest(0, least(1000 - 64, count(*) - 128)) FROM part UNION ALL SELECT 'scroll', least(0, count(*)) FROM part")
def row_window_seek(spark, d):
    w = view.RowWindow(_table(spark, d, "part").count(), 128)
    moves = [("seek", w.seek(1990).first), ("center", w.center(1000).first), ("scroll", w.seek(50).scroll(-80).first)]
    return spark.createDataFrame(moves, "move string, first long")


@query("""WITH n AS (SELECT p_partkey AS n FROM part UNION ALL SELECT o_orderkey * 37 FROM orders)
SELECT n, CASE WHEN n >= 2958466 THEN n::VARCHAR WHEN n = 0 THEN '1900-01-00' WHEN n = 60 THEN '1900-02-29' WHEN n < 60 THEN strftime(DATE '1899-12-31' + n::INT, '%Y-%m-%d') ELSE strftime(DATE '1899-12-30' + n::INT, '%Y-%m-%d') END AS shown FROM n""")
def xlsx_serial_text(spark, d):
    n = _table(spark, d, "part", "p_partkey").union(_table(spark, d, "orders", "o_orderkey").select(F.col("o_orderkey") * 37)).toDF("n")
    folder = files.write_workbooks(n, lambda r: [files.number_cell(str(r["n"])), files.number_cell(str(r["n"]), 1)], [0, 14], "serials")
    return _sheet(spark, folder).select(F.col("c")[0].cast("long").alias("n"), F.col("c")[1].alias("shown"))


def _sheet(spark, folder: str) -> DataFrame:
    """Cell texts of all rows of all workbooks of a folder."""
    return xlsx.read_sheet(spark, folder).select(F.transform("cells", lambda x: x["text"]).alias("c"))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 14 AND 17 THEN '1900-01-01' WHEN p_size BETWEEN 18 AND 21 OR p_size BETWEEN 45 AND 47 THEN '12:00:00' WHEN p_size = 22 THEN '1900-01-01 12:00:00' ELSE '1.5' END AS shown FROM part")
def xlsx_format_kind(spark, d):
    """One and a half in the number format of each part's size."""
    part = _table(spark, d, "part", "p_partkey", "p_size")
    folder = files.write_workbooks(part, lambda r: [files.number_cell(str(r["p_partkey"])), files.number_cell("1.5", r["p_size"])], list(range(64)), "formats")
    return _sheet(spark, folder).select(F.col("c")[0].cast("long").alias("p_partkey"), F.col("c")[1].alias("shown"))


@query("""SELECT p_partkey, p_name || ' <&>' AS name, CASE WHEN p_partkey % 2 = 0 THEN 'shared & first' ELSE 'two runs' END AS shared, CASE WHEN p_partkey % 3 = 0 THEN 'TRUE' ELSE 'FALSE' END AS flag, strftime(DATE '1899-12-30' + (1000 + p_partkey % 9000)::INT, '%Y-%m-%d') AS day FROM part""")
def workbook_cells(spark, d):
    """Numbers, texts, shared strings, booleans and dates, through workbooks and back."""
    part = _table(spark, d, "part", "p_partkey", "p_name")
    made = lambda r: [files.number_cell(str(r["p_partkey"])), files.text_cell(r["p_name"] + " <&>"), files.shared_cell(r["p_partkey"] % 2), files.boolean_cell(r["p_partkey"] % 3 == 0), files.number_cell(str(1000 + r["p_partkey"] % 9000), 1)]
    c = F.col("c")
    return _sheet(spark, files.write_workbooks(part, made, [0, 14], "cells")).select(c[0].cast("long").alias("p_partkey"), c[1].alias("name"), c[2].alias("shared"), c[3].alias("flag"), c[4].alias("day"))


@query("SELECT * FROM (VALUES (0, 'Kept', true, true), (1, 'Away', false, false)) AS v(position, name, visible, offered)")
def workbook_sheets(spark, d):
    folder = files.write_workbooks(_table(spark, d, "region", "r_regionkey").coalesce(1), lambda r: [files.number_cell(str(r["r_regionkey"]))], [0], "sheets")
    return xlsx.read_sheets(spark, folder).select("position", "name", "visible", "offered")


@query("""SELECT p_partkey, CASE WHEN p_partkey <= 26 THEN chr((64 + p_partkey)::INT) WHEN p_partkey <= 702 THEN chr((65 + (p_partkey - 27) // 26)::INT) || chr((65 + (p_partkey - 27) % 26)::INT)
ELSE chr((65 + (p_partkey - 703) // 676)::INT) || chr((65 + (p_partkey - 703) // 26 % 26)::INT) || chr((65 + (p_partkey - 703) % 26)::INT) END AS letters FROM part WHERE p_partkey BETWEEN 1 AND 16384""")
def xlsx_letters(spark, d):
    return _table(spark, d, "part", "p_partkey").where("p_partkey between 1 and 16384").select("p_partkey", T.column_letters(F.col("p_partkey")).alias("letters"))


@query("""SELECT o_orderkey, CASE WHEN b >= 1073741824 THEN ((b * 10 + 1073741823) // 1073741824) // 10 || '.' || ((b * 10 + 1073741823) // 1073741824) % 10 || ' GB' ELSE (b + 1048575) // 1048576 || ' MB' END AS size FROM (SELECT o_orderkey, o_orderkey * 777777 AS b FROM orders)""")
def size_labels(spark, d):
    return _table(spark, d, "orders", "o_orderkey").select("o_orderkey", T.size_text(F.col("o_orderkey") * 777777).alias("size"))


@query("SELECT event_type AS path, count(*) AS records, sum(strlen(props))::BIGINT AS payload_bytes FROM events GROUP BY 1")
def progress_counts(spark, d):
    return counted(_table(spark, d, "events", "event_type", "props").select(F.col("event_type").alias("path"), F.col("props").alias("value")))


@query("""SELECT '{"records":' || count(*) || ',"payload_bytes":' || coalesce(sum(strlen(text)), 0)::BIGINT || '}' AS summary FROM benchmark""")
def summary(spark, d):
    return summary_json(_table(spark, d, "benchmark"))
