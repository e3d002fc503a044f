"""Queries over values and tables: rules, HTML, headers, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import text as tx
from tablewright.functions import values as vl
from tablewright.functions.cells import parse_table, table_grid
from tablewright.operators.headers import classify_columns, infer_headers, label_columns, long_grid, looks_like_header
from tablewright.operators.merge import batch_of, row_text, source_columns, source_rows
from tablewright.operators.tables import add_headers, convert_tables, extract_tables, header_rows, row_estimate, sheet_names, sheet_titles, table_markdown
from tablewright.plans.inputs import joined, pad, table, text


# ------------------------------------------------------------------ values

def loop_detect(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.trailing_loop(F.col("text")).cast("long").alias("unit"))


_LOOP = "(k * greatest(10, CAST(ceil(300.0 / k) AS BIGINT)))"
_LOOP_SQL = f"SELECT doc_id, list_filter(range(1, 61), lambda k: length(t) >= {_LOOP} AND right(t, {_LOOP}) = repeat(right(t, k), greatest(10, CAST(ceil(300.0 / k) AS BIGINT))))[1] AS unit FROM (SELECT doc_id, right(text, 600) AS t FROM documents)"


def loop_start(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.loop_start("text").cast("long").alias("start"))


_START_SQL = f"""
SELECT d.doc_id, CASE WHEN u.unit IS NOT NULL THEN length(d.text) - u.unit * list_max(list_filter(range(1, length(d.text) // u.unit + 1), lambda m: right(d.text, u.unit * m) = repeat(right(d.text, u.unit), m))) END AS start
FROM documents d JOIN ({_LOOP_SQL}) u ON d.doc_id = u.doc_id
"""


def wide_text(spark, sf):
    """Names in full-width letters: NFKC gives them back."""
    p = table(spark, sf, "part")
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789#-"
    wide = "".join(chr(ord(c) + 0xFEE0) for c in plain)
    return p.select("p_partkey", tx.nfkc(F.translate("p_name", plain, wide)).alias("name"), tx.display_width(F.translate("p_name", plain, wide)).cast("long").alias("width"))


_WIDE_SQL = r"SELECT p_partkey, p_name AS name, CAST(length(p_name) + length(regexp_replace(p_name, '[^A-Za-z0-9#\-]', '', 'g')) AS BIGINT) AS width FROM part"


def canonical(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", vl.canon(tx.nfkc(text("（", F.col("n_name"), "）・サーバー 　", "－12-", F.col("n_nationkey"), ", ."))).alias("canon"), tx.strip(text("　 \t", F.col("n_name"), " \n")).alias("stripped"))


_CANON_SQL = "SELECT n_nationkey, regexp_replace(lower(n_name), '[ ()/,.-]', '', 'g') || 'サバ12' || n_nationkey AS canon, n_name AS stripped FROM nation"


def tidy_values(spark, sf):
    o = table(spark, sf, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    date = F.when(k % 4 == 0, text(F.year(d), "年", F.month(d), "月", F.dayofmonth(d), "日")).when(k % 4 == 1, text(" ", F.month(d), " ／ ", F.dayofmonth(d))).when(k % 4 == 2, text(F.month(d), ".", F.dayofmonth(d), "x")).otherwise(text("13/", F.dayofmonth(d)))
    postal = F.when(k % 3 == 0, text("〒", pad(k % 10000000, 7))).when(k % 3 == 1, text(F.translate(pad(k % 1000, 3), "0123456789", "０１２３４５６７８９"), "-1234")).otherwise(text("12-", k % 100))
    phone = F.when(k % 3 == 0, text("03 - ", pad(k % 10000, 4), " - 0001")).when(k % 3 == 1, text("090", pad(k % 100000000, 8))).otherwise(text("9", k))
    raw = tx.nfkc_arrays(o.select("o_orderkey", F.array(date, postal, phone).alias("raw")), v="raw")
    out = raw.select("o_orderkey", *[vl.tidy(F.col("v")[i], kind).alias(kind) for i, kind in enumerate(("date", "postal", "phone"))])
    return out.select("*", *[vl.problem(F.col(kind), kind).isNull().alias(f"{kind}_ok") for kind in ("date", "postal", "phone")])


_TIDY_SQL = """
SELECT o_orderkey, CASE k % 4 WHEN 0 THEN year(d) || '/' || month(d) || '/' || day(d) WHEN 1 THEN month(d) || '/' || day(d) WHEN 2 THEN month(d) || '.' || day(d) || 'x' ELSE '13/' || day(d) END AS date,
  CASE k % 3 WHEN 0 THEN left(p, 3) || '-' || right(p, 4) WHEN 1 THEN lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || '-1234' ELSE '12-' || (k % 100) END AS postal,
  CASE k % 3 WHEN 0 THEN '03-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') || '-0001' WHEN 1 THEN '090' || lpad(CAST(k % 100000000 AS VARCHAR), 8, '0') ELSE '9' || k END AS phone,
  k % 4 < 2 AS date_ok, k % 3 < 2 AS postal_ok, k % 3 < 2 AS phone_ok
FROM (SELECT o_orderkey, o_orderkey AS k, o_orderdate AS d, lpad(CAST(o_orderkey % 10000000 AS VARCHAR), 7, '0') AS p FROM orders)
"""


def split_dates(spark, sf):
    o = table(spark, sf, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    first = F.when(k % 3 == 0, text(pad(F.month(d), 2), "/", pad(F.dayofmonth(d), 2), "K")).when(k % 3 == 1, text(F.month(d), "・", F.dayofmonth(d), " ok、")).otherwise(text("none"))
    second = F.when(k % 2 == 0, text(F.translate(F.month(d).cast("string"), "0123456789", "０１２３４５６７８９"), "．", F.dayofmonth(d), "T")).otherwise(text(""))
    raw = tx.nfkc_arrays(o.select("o_orderkey", F.filter(F.array(first, second), lambda v: v != "").alias("raw")), v="raw")
    return raw.select("o_orderkey", vl.split_dates(F.col("v")).alias("s")).select("o_orderkey", F.col("s.first").alias("first"), joined(F.col("s.notes"), "|").alias("notes"))


_SPLIT_SQL = """
SELECT o_orderkey, CASE WHEN k % 3 < 2 OR k % 2 = 0 THEN md ELSE '' END AS first,
  concat_ws('|', CASE k % 3 WHEN 0 THEN 'K' WHEN 1 THEN 'o|k' ELSE 'none' END, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 3 = 2 THEN 'T' ELSE md || 'T' END END) AS notes
FROM (SELECT o_orderkey, o_orderkey AS k, month(o_orderdate) || '/' || day(o_orderdate) AS md FROM orders)
"""


def typed_values(spark, sf):
    k = F.col("p_partkey")
    v = F.when(k % 6 == 0, text(k)).when(k % 6 == 1, text("-", k)).when(k % 6 == 2, text("0", k)).when(k % 6 == 3, text("00", k, ".50")).when(k % 6 == 4, text(k, "-1")).otherwise(text("12345678901", pad(k, 5)))
    return table(spark, sf, "part").select("p_partkey", vl.typed_kind(v).alias("kind"), vl.typed_number(v).alias("number"))


_TYPED_SQL = """
SELECT p_partkey, CASE WHEN p_partkey = 0 THEN 'string' WHEN p_partkey % 6 < 2 THEN 'int' WHEN p_partkey % 6 = 3 THEN 'float' ELSE 'string' END AS kind,
  CAST(CASE p_partkey % 6 WHEN 0 THEN nullif(p_partkey, 0) WHEN 1 THEN -p_partkey WHEN 3 THEN p_partkey + 0.5 END AS DOUBLE) AS number FROM part
"""


def missing_chars(spark, sf):
    from tablewright.operators.audit import lost_characters
    p = table(spark, sf, "part")
    whole = vl.canon(F.col("p_name"))
    return p.select("p_partkey", lost_characters(whole, F.substring(whole, 1, 7)).alias("lost"))


_MISSING_SQL = """
WITH c AS (SELECT p_partkey, regexp_replace(lower(p_name), '[ ()/,.-]', '', 'g') AS s FROM part),
u AS (SELECT p_partkey, unnest(string_split(s, '')) AS ch, unnest(range(1, length(s) + 1)) AS i FROM c)
SELECT c.p_partkey, coalesce(string_agg(x.r, '' ORDER BY x.ch), '') AS lost FROM c LEFT JOIN (
  SELECT p_partkey, ch, repeat(ch, CAST(count(*) - count(*) FILTER (WHERE i <= 7) AS INTEGER)) AS r FROM u WHERE regexp_matches(ch, '^[0-9a-z]$') GROUP BY 1, 2) x ON x.p_partkey = c.p_partkey GROUP BY 1
"""


# ------------------------------------------------------------------ tables

def _region_html(spark, sf):
    """A table for each region: its nations, the region's name spanning their rows."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = n.groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    rows = F.transform("l", lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, F.concat(F.lit('<td rowspan="'), F.size("l").cast("string"), F.lit('">'), F.col("r_name"), F.lit("</td>"))).otherwise(F.lit("")), F.lit("<td>"), F.replace(x["n_name"], F.lit(" "), F.lit(" \t ")), F.lit("</TD><td>"), x["n_nationkey"].cast("string"), F.lit(" &amp; |<br>x</td></tr>")))
    markup = F.concat(F.lit('<TABLE border=1><tr><th>R</th><th colspan="2">N &lt; K</th></tr>'), F.array_join(rows, "\n"), F.lit("</table>"))
    return g.select(F.col("r_regionkey").alias("doc"), F.concat(F.lit("before "), F.col("r_name"), F.lit(" "), markup, F.lit(" after <table ></table>\n")).alias("text"))


def html_grid(spark, sf):
    t = extract_tables(_region_html(spark, sf), ["doc"]).where("rows is not null")
    cells = long_grid(t, ["doc", "table_no"])
    return cells.select("doc", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "value")


_GRID_SQL = """
WITH n AS (SELECT n_regionkey AS doc, r_name, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT DISTINCT doc, 0 AS r, c, CASE c WHEN 0 THEN 'R' WHEN 1 THEN 'N < K' ELSE '' END AS value FROM n, range(0, 3) t(c)
UNION ALL SELECT doc, r, 0, CASE WHEN r = 1 THEN r_name ELSE '' END FROM n UNION ALL SELECT doc, r, 1, n_name FROM n UNION ALL SELECT doc, r, 2, n_nationkey || ' & |' || chr(10) || 'x' FROM n
"""


def span_blocks(spark, sf):
    t = extract_tables(_region_html(spark, sf), ["doc"]).where("rows is not null")
    return t.select("doc", joined(F.transform("merges", lambda m: F.concat_ws(":", m["r1"], m["c1"], m["r2"], m["c2"])), " ").alias("merges"), "header")


_SPANS_SQL = "SELECT n_regionkey AS doc, '0:1:0:2 1:0:' || count(*) || ':0' AS merges, true AS header FROM nation GROUP BY 1"


def table_text(spark, sf):
    t = extract_tables(_region_html(spark, sf), ["doc"]).where("rows is not null")
    return table_markdown(t).select("doc", "markdown")


_MD = "'| R | N < K |   |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || CASE WHEN r = 1 THEN r_name ELSE ' ' END || ' | ' || n_name || ' | ' || n_nationkey || ' & \\|<br>x |', chr(10) ORDER BY r)"
_N = "(SELECT n_regionkey AS doc, r_name, n_name, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation JOIN region ON n_regionkey = r_regionkey)"
_MD_SQL = f"SELECT doc, {_MD} AS markdown FROM {_N} GROUP BY doc"


def convert_text(spark, sf):
    return convert_tables(_region_html(spark, sf), ["doc"])[0]


_CONVERT_SQL = f"SELECT doc, 'before ' || max(r_name) || ' ' || chr(10) || chr(10) || {_MD} || chr(10) || chr(10) || ' after <table ></table>' AS text FROM {_N} GROUP BY doc"


def estimates(spark, sf):
    t = sheet_names(extract_tables(_region_html(spark, sf), ["doc"]), ["doc"], page="doc")
    return t.groupBy("doc").agg(F.max("sheet").alias("sheet")).join(row_estimate(t.where("rows is not null"), ["doc"]), "doc")


_ESTIMATE_SQL = "SELECT n_regionkey AS doc, 'Page' || n_regionkey || '_2' AS sheet, CAST(1 AS BIGINT) AS tables, count(*) AS rows FROM nation GROUP BY 1"


def _ledger(spark, sf):
    """A headerless grid for each nation, a row for each of its customers."""
    k = F.col("c_custkey")
    kanji = F.translate(pad(k % 1000, 3), "0123456789", "山川田中村木林森石水")
    row = F.array(text(k % 12 + 1, "/", k % 28 + 1), F.lit("信金"), kanji, F.concat(F.substring(kanji, 2, 2)), text(pad(k % 1000, 3), "-", pad(k % 10000, 4)), text("東京都", F.substring(kanji, 1, 1), "市", k), text("03-", pad(k % 10000, 4), "-", pad(k % 1000, 4)), F.when(k % 2 == 0, text(pad(k % 1000, 3), "-0000")).otherwise(F.lit("?")))
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("doc"), F.lit(0).alias("table_no"), k.alias("k"), row.alias("row"))
    return c.groupBy("doc", "table_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda x: x["row"]).alias("grid"))


def column_types(spark, sf):
    t = classify_columns(long_grid(_ledger(spark, sf), ["doc"]), ["doc"])
    return t.select("doc", F.col("c").cast("long").alias("c"), "type")


_G = """(SELECT c_nationkey AS doc, count(*) AS n, count(*) FILTER (WHERE c_custkey % 2 = 0) AS even, count(DISTINCT c_custkey % 1000) AS names, count(DISTINCT c_custkey % 100) AS tails,
  arg_min(c_custkey % 2, c_custkey) AS lead FROM customer GROUP BY 1)"""
_TYPES_SQL = f"""
SELECT doc, c, CASE WHEN n < 2 THEN NULL ELSE CASE c WHEN 0 THEN '日付' WHEN 2 THEN CASE WHEN names * 2 >= n THEN '名前' END WHEN 3 THEN CASE WHEN tails * 2 >= n THEN '名前' END
  WHEN 4 THEN '郵便番号' WHEN 5 THEN '住所' WHEN 6 THEN '電話番号' WHEN 7 THEN CASE WHEN even >= 0.6 * n THEN '郵便番号' END END END AS type FROM {_G} g, range(0, 8) t(c)
"""


def inferred_headers(spark, sf):
    return infer_headers(_ledger(spark, sf), ["doc", "table_no"]).select("doc", joined(F.col("labels"), "|").alias("labels"), looks_like_header(F.col("grid")[0]).alias("header"))


_INFER_SQL = f"""
SELECT doc, CASE WHEN n >= 2 THEN '日付|列2|' || CASE WHEN names * 2 >= n AND tails * 2 >= n THEN '姓|名' WHEN names * 2 >= n THEN '氏名|列4' WHEN tails * 2 >= n THEN '列3|氏名' ELSE '列3|列4' END
  || '|郵便番号|住所|電話番号|' || CASE WHEN even >= 0.6 * n THEN '郵便番号2' ELSE '列8' END END AS labels, false AS header FROM {_G} g
"""


def add_header_rows(spark, sf):
    """HTML tables without headers get inferred ones as their first row."""
    g = _ledger(spark, sf)
    markup = F.concat(F.lit("<table>"), F.array_join(F.transform("grid", lambda r: F.concat(F.lit("<tr><th>"), F.array_join(r, "</th><th>"), F.lit("</th></tr>"))), ""), F.lit("</table>"))
    t = add_headers(extract_tables(g.select("doc", markup.alias("text")), ["doc"]), ["doc"])
    return t.select("doc", "inferred", F.size("grid").cast("long").alias("rows"), F.size(F.filter(F.flatten("rows"), lambda c: c["header"])).cast("long").alias("heads"))


_ADD_SQL = f"SELECT doc, n >= 2 AS inferred, n + CASE WHEN n >= 2 THEN 1 ELSE 0 END AS rows, CAST(8 AS BIGINT) AS heads FROM {_G} g"


def _order_pages(spark, sf):
    """Per customer three pages of orders: two with headers (one in another order), one without."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 3).alias("page"), F.col("o_orderkey").alias("k"))
    a, b = text("o", F.col("k")), text("s", F.col("k") % 7)
    row = F.when(F.col("page") == 1, F.array(b, a)).otherwise(F.array(a, b))
    g = o.select("doc", "page", "k", row.alias("row")).groupBy("doc", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda x: x["row"]).alias("body"))
    head = F.when(F.col("page") == 0, F.array(F.lit("番号"), F.lit(""))).otherwise(F.array(F.lit("状態"), F.lit("番号")))
    blank = F.array(F.lit(" "), F.lit("　"))
    grid = F.when(F.col("page") == 2, F.concat(F.col("body"), F.array(blank))).when(F.col("page") == 0, F.concat(F.array(head), F.col("body"))).otherwise(F.concat(F.array(head), F.col("body"), F.array(head)))
    return g.select("doc", "page", F.lit(0).alias("table_no"), grid.alias("grid"), (F.col("page") < 2).alias("header"))


def merge_pages(spark, sf):
    rows = source_rows(_order_pages(spark, sf))
    return rows.select("doc", "idx", "page", batch_of(F.col("idx"), 15).alias("batch"), row_text(F.col("cells")).alias("text"), joined(F.transform("cells", lambda c: c["header"])).alias("headers"))


_MERGE_SQL = """
SELECT o_custkey AS doc, row_number() OVER w - 1 AS idx, o_orderkey % 3 AS page, (row_number() OVER w - 1) // 15 AS batch,
  CASE WHEN o_orderkey % 3 = 1 THEN 's' || (o_orderkey % 7) || ' o' || o_orderkey ELSE 'o' || o_orderkey || ' s' || (o_orderkey % 7) END AS text,
  CASE o_orderkey % 3 WHEN 0 THEN '番号,列2' WHEN 1 THEN '状態,番号' ELSE '列1,列2' END AS headers
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey % 3, o_orderkey)
"""


def merged_columns(spark, sf):
    return source_columns(_order_pages(spark, sf)).select("doc", joined(F.col("columns")).alias("columns"))


_COLUMNS_SQL = """
SELECT doc, CASE WHEN p0 THEN '番号,列2' || CASE WHEN p1 THEN ',状態' ELSE '' END || CASE WHEN p2 THEN ',列1' ELSE '' END
  WHEN p1 THEN '状態,番号' || CASE WHEN p2 THEN ',列1,列2' ELSE '' END ELSE '列1,列2' END AS columns
FROM (SELECT o_custkey AS doc, bool_or(o_orderkey % 3 = 0) AS p0, bool_or(o_orderkey % 3 = 1) AS p1, bool_or(o_orderkey % 3 = 2) AS p2 FROM orders GROUP BY 1)
"""

def titles(spark, sf):
    """Sheet titles of parts, by brand: long, blank and clashing names."""
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, text("a/b*", k % 5)).when(k % 3 == 1, text("")).otherwise(text("a very long name of a sheet, cut ", k))
    p = table(spark, sf, "part").select("p_partkey", "p_brand", name.alias("name"))
    return sheet_titles(p, ["p_brand"], "name", "p_partkey").select("p_partkey", "title")


_TITLES_SQL = """
WITH b AS (SELECT p_partkey, p_brand, CASE p_partkey % 3 WHEN 0 THEN 'a_b_' || (p_partkey % 5) WHEN 1 THEN 'Sheet' ELSE 'a very long name of a sheet,' END AS base FROM part)
SELECT p_partkey, base || CASE WHEN row_number() OVER w > 1 THEN '_' || row_number() OVER w ELSE '' END AS title FROM b WINDOW w AS (PARTITION BY p_brand, base ORDER BY p_partkey)
"""


def sql_functions(spark, sf):
    """The functions under their SQL names, the table function too."""
    from tablewright.functions.register import register
    register(spark)
    _region_html(spark, sf).createOrReplaceTempView("region_html")
    return spark.sql("SELECT doc, table_no, CAST(r AS BIGINT) AS r, c, nfkc(value) AS value FROM region_html, LATERAL html_cells(text) WHERE c = 1")


_SQL_SQL = """
WITH n AS (SELECT n_regionkey AS doc, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation)
SELECT DISTINCT doc, 0 AS table_no, 0 AS r, 1 AS c, 'N < K' AS value FROM n UNION ALL SELECT doc, 0, r, 1, n_name FROM n
"""

def sheet_header_rows(spark, sf):
    """Rows of header cells only, wherever they stand: those that a sheet prints bold."""
    k = F.col("p_partkey")
    head = F.concat(F.lit("<tr><th>"), F.col("p_brand"), F.lit("</th><th>n</th></tr>"))
    body = F.concat(F.lit("<tr><th>row</th><td>"), k.cast("string"), F.lit("</td></tr>"))
    html = F.concat(F.lit("<table>"), F.when(k % 2 == 0, head).otherwise(""), body, F.when(k % 3 == 0, head).otherwise(""), body, F.lit("</table>"))
    tables = extract_tables(table(spark, sf, "part").select("p_partkey", html.alias("text")), ["p_partkey"])
    return tables.select("p_partkey", joined(header_rows(F.col("rows"))).alias("header_rows"))


_BOLD_SQL = """
SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN '0,2' WHEN p_partkey % 2 = 0 THEN '0' WHEN p_partkey % 3 = 0 THEN '1' ELSE '' END AS header_rows FROM part
"""

ALL = {
    "loop_detect": (loop_detect, _LOOP_SQL), "loop_start": (loop_start, _START_SQL), "wide_text": (wide_text, _WIDE_SQL), "canonical": (canonical, _CANON_SQL), "tidy_values": (tidy_values, _TIDY_SQL),
    "split_dates": (split_dates, _SPLIT_SQL), "typed_values": (typed_values, _TYPED_SQL), "missing_chars": (missing_chars, _MISSING_SQL), "html_grid": (html_grid, _GRID_SQL),
    "span_blocks": (span_blocks, _SPANS_SQL), "table_markdown": (table_text, _MD_SQL), "convert_tables": (convert_text, _CONVERT_SQL), "row_estimate": (estimates, _ESTIMATE_SQL),
    "classify_columns": (column_types, _TYPES_SQL), "infer_headers": (inferred_headers, _INFER_SQL), "add_headers": (add_header_rows, _ADD_SQL), "merge_pages": (merge_pages, _MERGE_SQL),
    "source_columns": (merged_columns, _COLUMNS_SQL), "sheet_titles": (titles, _TITLES_SQL), "sql_functions": (sql_functions, _SQL_SQL), "sheet_header_rows": (sheet_header_rows, _BOLD_SQL),
}
