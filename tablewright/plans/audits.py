"""Queries over reshaped rows: the flagship, its issues and reports; streams; exports."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from tablewright.config import NOTES
from tablewright.operators import report
from tablewright.operators.audit import audit, issue_rows, template_rows
from tablewright.operators.cache import newest
from tablewright.operators.merge import batch_of, source_columns, source_rows
from tablewright.operators.pages import is_scan, needs_recognition
from tablewright.operators.reshape import RuleReshaper, last_answers, parse_answer, reshape
from tablewright.operators.tables import extract_tables, row_estimate
from tablewright.plans.inputs import joined, pad, table, text
from tablewright.sinks.exports import expired, may_download
from tablewright.sinks.xlsx import BOOKS_AT_ONCE, XlsxSink, read_notes, read_values, saved
from tablewright.sources.pages import TextPages, page_jobs, read_pages
from tablewright.streaming.recognition import cut_streams, sse_deltas

TEMPLATE = ["日付", "番号", "郵便番号", "電話番号"]


class SeededReshaper:
    """A stand-in service with faults that the key in a row's number decides.

    Keys divisible by 10 get no answer; else by 7 the number's letter is
    changed; else by 5 the postal code loses its last digit.
    """

    def reshape(self, template, columns, rows):
        out = []
        for src, values in rows:
            row = dict(zip(columns, values))
            key = int(row["番号"][1:])
            if key % 10 == 0:
                continue
            if key % 7 == 0:
                row["番号"] = "B" + row["番号"][1:]
            elif key % 5 == 0:
                row["郵便番号"] = row["郵便番号"][:-1]
            out.append({"src": src, **{c: row.get(c, "") for c in template}, NOTES: ""})
        return out


def recognised_pages(spark, sf):
    """(doc, page, text): two pages for each customer, a table of orders on each."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    code = F.when(k % 4 == 0, "K").otherwise("")
    date = text(F.month("o_orderdate"), "/", F.dayofmonth("o_orderdate"), code)
    postal = pad(k % 10000000, 7)
    cells = F.array(date, text("A", k), F.concat(F.substring(postal, 1, 3), F.lit("-"), F.substring(postal, 4, 4)), text("03-", pad(k % 10000, 4), "-", pad(k % 9999, 4)))
    row = F.concat(F.lit("<tr><td>"), F.array_join(cells, "</td><td>"), F.lit("</td></tr>"))
    g = o.select(F.col("o_custkey").alias("doc"), (k % 2 + 1).alias("page"), k.alias("k"), row.alias("row")).groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("k", "row"))).alias("rows"))
    head = "<table><tr>" + "".join(f"<th>{c}</th>" for c in TEMPLATE) + "</tr>"
    return g.select("doc", "page", F.concat(F.lit("page text\n" + head), F.array_join(F.transform("rows", lambda x: x["row"]), ""), F.lit("</table>")).alias("text"))


def _tables(spark, sf):
    # One shuffle by document: windows, batches and joins below all go by it. The
    # tables feed the rows, the columns and both joins, and are parsed once.
    pages = recognised_pages(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc")
    return extract_tables(pages, ["doc", "page"]).persist()


def _audited(spark, sf, tables=None):
    tables = _tables(spark, sf) if tables is None else tables
    columns, rows = source_columns(tables), source_rows(tables)
    shaped = reshape(rows, columns, TEMPLATE, SeededReshaper())
    return audit(rows, shaped, TEMPLATE, columns)


def format_flagship(spark, sf):
    """Recognised pages to audited rows: tables, merging, reshaping in batches, rules, audit."""
    a = _audited(spark, sf)
    return a.select("doc", F.col("n").cast("long").alias("n"), joined(F.col("columns")).alias("columns"), joined(F.col("values"), "|").alias("row"), F.size("issues").cast("long").alias("n_issues"))


_ROWS = """
WITH o AS (SELECT o_custkey AS doc, o_orderkey % 2 + 1 AS page, o_orderkey AS k, month(o_orderdate) || '/' || day(o_orderdate) AS md, o_orderkey % 4 = 0 AS code, o_orderkey % 10 = 0 AS raw,
  o_orderkey % 10 <> 0 AND o_orderkey % 7 = 0 AS letter, o_orderkey % 10 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0 AS cut,
  lpad(CAST(o_orderkey % 10000000 AS VARCHAR), 7, '0') AS p, '03-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(o_orderkey % 9999 AS VARCHAR), 4, '0') AS tel FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, k) AS n, coalesce(bool_or(code AND NOT raw) OVER (PARTITION BY doc), false) AS noted FROM o)
"""
_FLAGSHIP_SQL = _ROWS + """
SELECT doc, n, '日付,番号,郵便番号,電話番号' || CASE WHEN noted THEN ',備考' ELSE '' END AS columns,
  md || CASE WHEN raw AND code THEN 'K' ELSE '' END || '|' || CASE WHEN letter THEN 'B' ELSE 'A' END || k || '|' || left(p, 3) || '-' || CASE WHEN cut THEN substr(p, 4, 3) ELSE right(p, 4) END || '|' || tel || CASE WHEN noted THEN '|' || CASE WHEN code AND NOT raw THEN 'K' ELSE '' END ELSE '' END AS row,
  CAST(CASE WHEN raw THEN 1 + CASE WHEN code THEN 1 ELSE 0 END WHEN letter OR cut THEN 2 ELSE 0 END AS BIGINT) AS n_issues FROM r
"""


def audit_issues(spark, sf):
    return issue_rows(_audited(spark, sf)).select("doc", F.col("n").cast("long").alias("n"), F.col("seq").cast("long").alias("seq"), "column", "kind")


_ISSUES = """
i AS (SELECT doc, n, CAST(0 AS BIGINT) AS seq, '日付' AS "column", '未整形' AS kind FROM r WHERE raw UNION ALL SELECT doc, n, 1, '日付', '要確認' FROM r WHERE raw AND code
  UNION ALL SELECT doc, n, 0, '番号', '補正' FROM r WHERE letter UNION ALL SELECT doc, n, 0, '郵便番号', '要確認' FROM r WHERE cut
  UNION ALL SELECT doc, n, 1, CASE WHEN noted THEN '備考' ELSE '電話番号' END, '欠落の可能性' FROM r WHERE letter OR cut)
"""
_ISSUES_SQL = _ROWS + "," + _ISSUES + 'SELECT doc, n, seq, "column", kind FROM i'


def issue_counts(spark, sf):
    a = _audited(spark, sf)
    return report.issue_counts(issue_rows(a), a)


_COUNTS_SQL = _ROWS + "," + _ISSUES + """
SELECT d.doc, coalesce(nullif(concat_ws('・', CASE WHEN a > 0 THEN '補正 ' || a || '件' END, CASE WHEN b > 0 THEN '要確認 ' || b || '件' END, CASE WHEN c > 0 THEN '欠落の可能性 ' || c || '件' END, CASE WHEN e > 0 THEN '未整形 ' || e || '件' END), ''), 'なし') AS summary
FROM (SELECT DISTINCT doc FROM r) d LEFT JOIN (SELECT doc, count(*) FILTER (WHERE kind = '補正') AS a, count(*) FILTER (WHERE kind = '要確認') AS b, count(*) FILTER (WHERE kind = '欠落の可能性') AS c, count(*) FILTER (WHERE kind = '未整形') AS e FROM i GROUP BY 1) x ON x.doc = d.doc
"""


def result_markdown(spark, sf):
    return report.result_markdown(_audited(spark, sf))


_RESULT_SQL = _ROWS + """
SELECT doc, '| # | 日付 | 番号 | 郵便番号 | 電話番号 |' || CASE WHEN max(noted) THEN ' 備考 |' ELSE '' END || chr(10) || '|---|---|---|---|---|' || CASE WHEN max(noted) THEN '---|' ELSE '' END || chr(10)
  || string_agg('| ' || n || ' | ' || md || CASE WHEN raw AND code THEN 'K' ELSE '' END || CASE WHEN raw THEN ' ⚠' ELSE '' END || ' | ' || CASE WHEN letter THEN 'B' ELSE 'A' END || k || CASE WHEN letter THEN ' ✎' ELSE '' END
  || ' | ' || left(p, 3) || '-' || CASE WHEN cut THEN substr(p, 4, 3) || ' ⚠' ELSE right(p, 4) END || ' | ' || tel || CASE WHEN NOT noted AND (letter OR cut) THEN ' ⚠' ELSE '' END || ' |'
  || CASE WHEN noted THEN ' ' || CASE WHEN letter OR cut THEN CASE WHEN code THEN 'K ⚠' ELSE '⚠' END WHEN code AND NOT raw THEN 'K' ELSE ' ' END || ' |' ELSE '' END, chr(10) ORDER BY n) AS markdown FROM r GROUP BY doc
"""


def issue_list(spark, sf):
    a = _audited(spark, sf)
    lines = report.issues_markdown(issue_rows(a), a, limit=5)
    return lines.select("doc", F.size(F.split("markdown", "\n")).cast("long").alias("lines"), F.regexp_extract("markdown", r"- and (\d+) more\z", 1).alias("more"))


_LIST_SQL = _ROWS + "," + _ISSUES + """
SELECT d.doc, greatest(1, least(coalesce(c, 0), 5) + CASE WHEN c > 5 THEN 1 ELSE 0 END) AS lines, CASE WHEN c > 5 THEN CAST(c - 5 AS VARCHAR) ELSE '' END AS more
FROM (SELECT DISTINCT doc FROM r) d LEFT JOIN (SELECT doc, count(*) AS c FROM i GROUP BY 1) x ON x.doc = d.doc
"""


def spread_rows(spark, sf):
    return template_rows(_audited(spark, sf), ["番号", NOTES]).select("doc", F.col("n").cast("long").alias("n"), F.col("番号").alias("number"), F.col(NOTES).alias("notes"))


_SPREAD_SQL = _ROWS + "SELECT doc, n, CASE WHEN letter THEN 'B' ELSE 'A' END || k AS number, CASE WHEN noted THEN CASE WHEN code AND NOT raw THEN 'K' ELSE '' END END AS notes FROM r"


def rule_reshape(spark, sf):
    """The rule-based service: postal codes and telephones by content, the rest to the notes."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    cells = F.array(F.struct(F.lit("a").alias("header"), text(pad(k % 1000, 3), "-", pad(k % 10000, 4)).alias("value")), F.struct(F.lit("b").alias("header"), text("x", k).alias("value")),
                    F.struct(F.lit("c").alias("header"), text("03-", pad(k % 10000, 4), "-", pad(k % 10000, 4)).alias("value")))
    from pyspark.sql import Window
    rows = o.select(F.col("o_custkey").alias("doc"), k.alias("k"), cells.alias("cells")).withColumn("idx", F.row_number().over(Window.partitionBy("doc").orderBy("k")) - 1)
    columns = rows.select("doc").distinct().withColumn("columns", F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    shaped = reshape(rows.withColumn("idx", F.col("idx").cast("long")), columns, ["郵便番号", "電話番号", NOTES], RuleReshaper())
    v = F.col("values")
    return shaped.select("doc", "src", v["郵便番号"].alias("postal"), v["電話番号"].alias("phone"), v[NOTES].alias("notes"))


_RULE_SQL = """
SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS src, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS postal,
  '03-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS phone, 'x' || o_orderkey AS notes FROM orders
"""


def answers(spark, sf):
    """JSON answers of a service, the last one for each row."""
    li = table(spark, sf, "lineitem")
    raw = F.when(F.col("l_linenumber") % 4 == 0, F.lit("{broken")).otherwise(text('{"rows":[{"src":', F.col("l_linenumber") % 2, ',"番号":"n', F.col("l_linenumber"), '"}]}'))
    rows = li.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), F.explode(parse_answer(raw, ["番号"])).alias("row"))
    last = last_answers(rows.select("doc", F.col("row.src").alias("src"), F.col("row.番号").alias("values"), "pos"))
    return last.select("doc", F.col("src").cast("long").alias("src"), F.col("values").alias("number"))


_ANSWERS_SQL = "SELECT l_orderkey AS doc, CAST(l_linenumber % 2 AS BIGINT) AS src, 'n' || max(l_linenumber) AS number FROM lineitem WHERE l_linenumber % 4 <> 0 GROUP BY 1, 2"


def progress(spark, sf):
    tables = extract_tables(recognised_pages(spark, sf), ["doc", "page"]).persist()
    rows = source_rows(tables)
    batches = rows.groupBy("doc", batch_of(F.col("idx"), 15).alias("batch")).agg(F.count("*").alias("rows"))
    return report.progress_lines(row_estimate(tables, ["doc", "page"]), batches)


_PROGRESS_SQL = _ROWS + """
SELECT doc, page AS seq, '- page ' || page || ': 1 tables, about ' || count(*) || ' rows' AS line FROM r GROUP BY doc, page
UNION ALL SELECT doc, 1000000 + b, '- batch ' || (b + 1) || '/' || count(*) OVER (PARTITION BY doc) || ': ' || c || ' rows' FROM (SELECT doc, (n - 1) // 15 AS b, count(*) AS c FROM r GROUP BY 1, 2)
"""


def usage_totals(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.struct((F.col("event_id") % 7).alias("prompt_tokens"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 5).alias("completion_tokens"), F.lit(3).cast("long").alias("total_tokens")).alias("usage"))
    return report.usage_totals(e)


_USAGE_SQL = "SELECT user_id AS doc, CAST(sum(event_id % 7) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(CASE WHEN event_id % 2 = 0 THEN event_id % 5 END), 0) AS BIGINT) AS completion_tokens, CAST(sum(3) AS BIGINT) AS total_tokens FROM events GROUP BY 1"


def stream_lines(spark, sf):
    """Server-sent lines of events: deltas, with bad lines dropped and failed streams as errors."""
    e = table(spark, sf, "events")
    k = F.col("event_id")
    line = F.when(k % 3 == 0, text(": ping")).when(k % 3 == 1, text('data: {"choices":[{"delta":{"content":"d', k, '"}},{"delta":{}}]}')).otherwise(text('data: {"choices":[],"usage":{"prompt_tokens":', k % 9, ',"completion_tokens":1,"total_tokens":2}}'))
    lines = e.select(F.col("user_id").alias("stream_id"), k.alias("seq"), line.alias("line"), F.when(F.col("user_id") % 10 == 0, 500).otherwise(200).alias("status"))
    out = sse_deltas(lines, status="status")
    return out.select("stream_id", "seq", "delta", F.col("usage.prompt_tokens").alias("prompt_tokens"))


_LINES_SQL = """
SELECT user_id AS stream_id, event_id AS seq, CASE event_id % 3 WHEN 1 THEN 'd' || event_id ELSE '' END AS delta, CASE event_id % 3 WHEN 2 THEN event_id % 9 END AS prompt_tokens FROM events WHERE user_id % 10 <> 0 AND event_id % 3 > 0
UNION ALL SELECT user_id, min(event_id), '[OCR error: ' || string_agg(CASE event_id % 3 WHEN 0 THEN ': ping' WHEN 1 THEN 'data: {"choices":[{"delta":{"content":"d' || event_id || '"}},{"delta":{}}]}'
  ELSE 'data: {"choices":[],"usage":{"prompt_tokens":' || event_id % 9 || ',"completion_tokens":1,"total_tokens":2}}' END, chr(10) ORDER BY event_id) || ']', NULL FROM events WHERE user_id % 10 = 0 GROUP BY 1
"""


def stream_cut(spark, sf):
    """Documents as streams of 50-character deltas, cut at their loops."""
    d = table(spark, sf, "documents").where("text is not null")
    n = F.greatest(F.ceil(F.length("text") / 50), F.lit(1))
    deltas = d.select(F.col("doc_id").alias("stream_id"), "text", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("seq")).select("stream_id", "seq", F.substring(F.col("text"), F.col("seq").cast("int") * 50 + 1, F.lit(50)).alias("delta"))
    return cut_streams(deltas).select("stream_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("md5"))


# Every prefix that ends with a delta is tested: the first one with a loop ends the stream. The
# cut goes back copy by copy, but not behind what was sent before (600 characters behind).
_CUT_SQL = """
WITH d AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, text, e, greatest(0, e - 50 - 600) AS sent, substr(text, greatest(0, e - 600) + 1, least(e, 600)) AS tail
  FROM (SELECT doc_id, text, least(n, 50 * unnest(range(1, n // 50 + 2))) AS e, n FROM d) WHERE e >= 300),
f AS (SELECT doc_id, text, e, sent, list_filter(range(1, 61), lambda k: length(tail) >= k * greatest(10, (299 + k) // k)
    AND right(tail, k * greatest(10, (299 + k) // k)) = repeat(right(tail, k), greatest(10, (299 + k) // k)))[1] AS k FROM p),
c AS (SELECT doc_id, min(e) AS e, arg_min(sent, e) AS sent, arg_min(k, e) AS k FROM f WHERE k IS NOT NULL GROUP BY doc_id),
b AS (SELECT c.doc_id, greatest(c.sent, c.e - c.k * coalesce(list_filter(range(1, c.e // c.k + 1), lambda i: substr(d.text, c.e - i * c.k + 1, c.k) <> substr(d.text, c.e - c.k + 1, c.k))[1] - 1, c.e // c.k)) AS cut FROM c JOIN d ON d.doc_id = c.doc_id)
SELECT d.doc_id AS stream_id, coalesce(b.cut, d.n) AS n_chars, md5(left(d.text, coalesce(b.cut, d.n))) AS md5 FROM d LEFT JOIN b ON b.doc_id = d.doc_id
"""


def stream_answer(spark, sf):
    t = table(spark, sf, "conversations").where("text is not null")
    usage = F.struct(F.lit(1).cast("long").alias("prompt_tokens"), F.lit(2).cast("long").alias("completion_tokens"), F.lit(3).cast("long").alias("total_tokens"))
    pieces = t.select(F.col("conv_id").alias("doc"), F.col("turn").alias("seq"), "text", F.lit("m").alias("model"), F.lit(7).cast("long").alias("created"), (F.col("conv_id") % 2 == 0).alias("include_usage"), usage.alias("usage"))
    return report.stream_answer(pieces)


_HEAD = "'data: {\"id\":\"' || conv_id || '\",\"object\":\"chat.completion.chunk\",\"created\":7,\"model\":\"m\",\"choices\":['"
_STREAM_SQL = f"""
SELECT conv_id AS doc, {_HEAD} || '{{"index":0,"delta":{{"role":"assistant","content":""}}}}]}}' || chr(10) || chr(10)
  || string_agg({_HEAD} || '{{"index":0,"delta":{{"content":' || to_json(text) || '}}}}]}}' || chr(10) || chr(10), '' ORDER BY turn)
  || {_HEAD} || '{{"index":0,"delta":{{}},"finish_reason":"stop"}}]}}' || chr(10) || chr(10)
  || CASE WHEN conv_id % 2 = 0 THEN {_HEAD} || '],"usage":{{"prompt_tokens":1,"completion_tokens":2,"total_tokens":3}}}}' || chr(10) || chr(10) ELSE '' END || 'data: [DONE]' || chr(10) || chr(10) AS answer
FROM conversations WHERE text IS NOT NULL GROUP BY conv_id
"""


def full_answer(spark, sf):
    t = table(spark, sf, "conversations").where("text is not null")
    usage = F.struct(F.lit(1).cast("long").alias("prompt_tokens"))
    pieces = t.select(F.col("conv_id").alias("doc"), F.col("turn").alias("seq"), "text", F.lit("m").alias("model"), F.lit(7).cast("long").alias("created"), usage.alias("usage"))
    return report.full_answer(pieces)


_FULL_SQL = """
SELECT conv_id AS doc, '{"id":"' || conv_id || '","object":"chat.completion","created":7,"model":"m","choices":[{"index":0,"message":{"role":"assistant","content":' || to_json(string_agg(text, '' ORDER BY turn)) || '},"finish_reason":"stop"}],"usage":{"prompt_tokens":1}}' AS answer
FROM conversations WHERE text IS NOT NULL GROUP BY conv_id
"""


def downloads(spark, sf):
    k = F.col("p_partkey")
    token = F.when(k % 2 == 0, F.md5(k.cast("string"))).otherwise(F.upper(F.md5(F.lit("a"))))
    name = F.when(k % 3 == 0, text(".", k)).when(k % 3 == 1, text("a/b")).otherwise(text("a", k, ".xlsx"))
    return table(spark, sf, "part").select("p_partkey", may_download(token, name).alias("may"), expired((k % 100 * 3600).cast("double"), F.lit(100 * 3600.0)).alias("expired"))


_DOWNLOAD_SQL = "SELECT p_partkey, p_partkey % 6 = 2 AS may, p_partkey % 100 < 28 AS expired FROM part"


def newest_entries(spark, sf):
    return newest(table(spark, sf, "events").select(F.col("event_id").alias("key"), F.col("value").alias("used")), 64)


_NEWEST_SQL = "SELECT event_id AS key, value AS used FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 64"


#: Folders that workbooks are spread over.
FOLDERS = 256


def _written(spark, books):
    """(path): the workbooks that the sink wrote to the shared folder.

    Tasks list the folders and open the files: the file source would look up every
    path on the driver and again in a task of its own, and deal out 32 small files
    to a task.
    """
    spark.dataSource.register(XlsxSink)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = os.path.join((shared or tempfile.gettempdir()).removeprefix("file://").removeprefix("file:"), f"xlsx-{uuid.uuid4().hex}")
    books.write.format("xlsx").option("folders", FOLDERS).mode("append").save(folder)
    return saved(spark, folder, FOLDERS)


def _read_back(files, doc, read, schema):
    """(doc, what ``read`` makes of each workbook): ``files`` of ``_written``, ``doc`` a column of the path.

    Some workbooks at a time, as one may be large.
    """
    files = files.select(doc.alias("doc"), "path")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BOOKS_AT_ONCE):
                part = batch.slice(at, BOOKS_AT_ONCE)
                rows = []
                for path in part.column(1).to_pylist():
                    with zipfile.ZipFile(path) as z:
                        rows.append(read(z))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*rows), schema))], ["doc", *schema.names])

    return files.mapInArrow(run, StructType([files.schema["doc"], *from_arrow_schema(schema)]))


def xlsx_roundtrip(spark, sf):
    """Workbooks of the regions' nations, written by the sink and read back: (doc, rows, cells)."""
    n = table(spark, sf, "nation")
    g = n.groupBy(F.col("n_regionkey").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    grid = F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.transform("l", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])))
    sheet = F.struct(F.lit("nations").alias("title"), grid.alias("grid"), F.array().cast("array<struct<r1:int,c1:int,r2:int,c2:int>>").alias("merges"), F.lit(True).alias("header"))
    files = _written(spark, g.select(text("region ", F.col("doc")).alias("name"), F.array(sheet).alias("sheets")))

    def read(z):
        sheet = read_values(z)["nations"]
        return len(sheet) - 1, "|".join(",".join(row) for row in sheet)

    doc = F.regexp_extract("path", r"region(?:%20| |_)(\d+)\.xlsx$", 1).cast("int")
    return _read_back(files, doc, read, pa.schema([("rows", pa.int64()), ("cells", pa.string())]))


_XLSX_SQL = "SELECT n_regionkey AS doc, count(*) AS rows, 'key,name|' || string_agg(n_nationkey || ',' || n_name, '|' ORDER BY n_nationkey) AS cells FROM nation GROUP BY 1"



def result_workbook(spark, sf):
    """A workbook for each document, read back: its rows, issues, comments and original tables."""
    tables = _tables(spark, sf)
    books = report.workbooks(_audited(spark, sf, tables), tables)
    files = _written(spark, books.select(text("d", F.col("doc")).alias("name"), "result", "sheets"))

    def read(z):
        sheets, notes = read_values(z), read_notes(z)
        main, listed, *originals = sheets.values()
        return (
            "\n".join("|".join(row) for row in main), "\n".join(",".join(row[:3]) for row in listed),
            ",".join(f"{at}:{note.split(':')[0]}" for at, note in sorted(notes.items(), key=lambda n: (int(n[0][1:]), n[0][0]))),
            ",".join(list(sheets)[2:]), sum(len(rows) for rows in originals))

    doc = F.regexp_extract("path", r"d(\d+)\.xlsx$", 1).cast("long")
    return _read_back(files, doc, read, pa.schema([*((name, pa.string()) for name in ("main", "listed", "notes", "originals")), ("original_rows", pa.int64())]))


_BOOK_SQL = _ROWS + "," + _ISSUES + f""",
m AS ({_FLAGSHIP_SQL.removeprefix(_ROWS)}),
a AS (SELECT doc, n, "column", arg_max(kind, seq) AS kind, CASE "column" WHEN '日付' THEN 'A' WHEN '番号' THEN 'B' WHEN '郵便番号' THEN 'C' WHEN '電話番号' THEN 'D' ELSE 'E' END || (n + 1) AS place FROM i GROUP BY 1, 2, 3),
pages AS (SELECT doc, string_agg('OCR原本_P' || page, ',' ORDER BY page) AS originals, CAST(sum(c + 1) AS BIGINT) AS original_rows FROM (SELECT doc, page, count(*) AS c FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT m.doc, replace(max(m.columns), ',', '|') || chr(10) || string_agg(m.row, chr(10) ORDER BY m.n) AS main,
  any_value('行,列,種類' || coalesce(chr(10) || l.listed, '')) AS listed, any_value(coalesce(x.notes, '')) AS notes, any_value(pages.originals) AS originals, any_value(pages.original_rows) AS original_rows
FROM m JOIN pages ON pages.doc = m.doc LEFT JOIN (SELECT doc, string_agg(n || ',' || "column" || ',' || kind, chr(10) ORDER BY n, seq) AS listed FROM i GROUP BY 1) l ON l.doc = m.doc
LEFT JOIN (SELECT doc, string_agg(place || ':' || kind, ',' ORDER BY n, place) AS notes FROM a GROUP BY 1) x ON x.doc = m.doc GROUP BY m.doc
"""


class ScannedPages(TextPages):
    """A stand-in for PDFs: even pages are scans; a page's image is its text's bytes."""

    def read(self, data, pages, images):
        for page in super().read(data, pages, images):
            shown = page["text"].encode()
            covered = [{"x0": 0.0, "y0": 0.0, "x1": 10.0, "y1": 6.0}] if page["page"] % 2 == 0 else []
            yield {**page, "text": "scanner's text" if covered else page["text"], "width": 10.0, "height": 10.0, "boxes": covered, "png": shown if images else None}


def pages_to_rows(spark, sf):
    """Documents of pages to rows of their tables: pages read, scans recognised, tables parsed and merged."""
    pages = F.array_sort(F.collect_list(F.struct("page", "text")))
    files = recognised_pages(spark, sf).groupBy("doc").agg(F.encode(F.array_join(F.transform(pages, lambda p: p["text"]), "\f"), "utf-8").alias("data"))
    read = read_pages(files, ScannedPages(), images=True)
    scan = is_scan(F.col("boxes"), F.col("width"), F.col("height"))
    said = F.when(needs_recognition(F.col("text"), scan), F.decode("png", "utf-8")).otherwise(F.col("text"))
    rows = source_rows(extract_tables(read.select("doc", "page", said.alias("text")), ["doc", "page"]))
    return rows.select("doc", (F.col("idx") + 1).alias("n"), F.col("page").cast("long").alias("page"), joined(F.transform("cells", lambda c: c["value"]), "|").alias("row"))


_PAGES_SQL = _ROWS + """
SELECT doc, n, dense_rank() OVER (PARTITION BY doc ORDER BY page) AS page, md || CASE WHEN code THEN 'K' ELSE '' END || '|A' || k || '|' || left(p, 3) || '-' || right(p, 4) || '|' || tel AS row FROM r
"""


def scan_jobs(spark, sf):
    """Recognition jobs of customers' files: a page for each order, some pages asked for, and single images."""
    c = F.col("o_custkey")
    orders = F.array_sort(F.collect_list("o_orderkey"))
    files = table(spark, sf, "orders").groupBy(c.alias("doc")).agg(F.array_join(F.transform(orders, lambda k: text("order ", k)), "\f").alias("said"))
    d = F.col("doc")
    jobs = files.select(
        "doc", (d % 4).cast("int").alias("ord"), F.when(d % 4 == 0, "image").otherwise("pdf").alias("kind"), F.when(d % 4 == 0, text("data:image/png;base64,AA", d)).alias("url"),
        F.when(d % 4 != 0, F.encode("said", "utf-8")).alias("data"), F.when(d % 4 == 1, F.array(F.lit(2), F.lit(3), F.lit(99)).cast("array<bigint>")).alias("pages"), F.lit("Table Recognition:").alias("prompt"), text("f", d).alias("source"))
    return page_jobs(jobs, ScannedPages()).select("doc", F.col("ord").cast("long").alias("ord"), F.col("page").cast("long").alias("page"), "url", "source")


_SCAN_JOBS_SQL = """
WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders)
SELECT doc, CAST(doc % 4 AS BIGINT) AS ord, page, CASE WHEN doc % 4 = 0 THEN 'data:image/png;base64,AA' || doc ELSE 'data:image/png;base64,' || to_base64(encode('order ' || k)) END AS url, 'f' || doc AS source
FROM o WHERE CASE WHEN doc % 4 = 0 THEN page = 1 WHEN doc % 4 = 1 AND c >= 2 THEN page IN (2, 3) ELSE page <= 20 END
"""

ALL = {
    "result_workbook": (result_workbook, _BOOK_SQL), "pages_to_rows": (pages_to_rows, _PAGES_SQL), "scan_jobs": (scan_jobs, _SCAN_JOBS_SQL),
    "format_flagship": (format_flagship, _FLAGSHIP_SQL), "audit_issues": (audit_issues, _ISSUES_SQL), "issue_counts": (issue_counts, _COUNTS_SQL), "result_markdown": (result_markdown, _RESULT_SQL),
    "issue_list": (issue_list, _LIST_SQL), "template_rows": (spread_rows, _SPREAD_SQL), "rule_reshape": (rule_reshape, _RULE_SQL), "service_answers": (answers, _ANSWERS_SQL), "usage_totals": (usage_totals, _USAGE_SQL),
    "stream_lines": (stream_lines, _LINES_SQL), "stream_cut": (stream_cut, _CUT_SQL), "stream_answer": (stream_answer, _STREAM_SQL), "full_answer": (full_answer, _FULL_SQL), "downloads": (downloads, _DOWNLOAD_SQL),
    "progress_lines": (progress, _PROGRESS_SQL), "newest_entries": (newest_entries, _NEWEST_SQL), "xlsx_roundtrip": (xlsx_roundtrip, _XLSX_SQL),
}
