"""Chat requests, pages, caches, streams, spreadsheets, exports, and the entry module."""

import json
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tablewright.config import Settings
from tablewright.functions.text import loop_begin
from tablewright.operators import requests as rq
from tablewright.operators.cache import cache_key, to_keep, with_cache
from tablewright.operators.pages import is_scan, selected_pages
from tablewright.sinks import exports, xlsx
from tablewright.sources.pages import PageSource, TextPages, read_pages
from tablewright.streaming.recognition import Cutter, cut_stream, cut_streams


def many(spark, column, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", column.alias("x")).orderBy("i").collect()]


def test_page_hints(spark):
    texts = ["the First Page", "1枚目", "２ページ目", "1〜3ページ", "pages 2-4", "pages 5-3", "page 0", "page 3, page 1 and page 3", "nothing", "3ページ", "page 2 to 1 ~ 2ページ", None]
    assert many(spark, rq.requested_pages(F.col("v")), texts) == [[1], [1], [2], [1, 2, 3], [2, 3, 4], [], [0], [1, 3], None, None, [1, 2], None]


def test_selected_pages(spark):
    df = spark.createDataFrame([(5, None), (5, []), (5, [0, 2, 9]), (5, [8]), (30, list(range(1, 26))), (30, None), (0, [1])], "n int, p array<bigint>")
    got = [r.x for r in df.select(selected_pages(F.col("n"), F.col("p")).alias("x")).collect()]
    assert got == [[1, 2, 3, 4, 5], [1, 2, 3, 4, 5], [2], [1, 2, 3, 4, 5], list(range(1, 26)), list(range(1, 21)), []]


def test_task_prompt(spark):
    texts = [" Table Recognition: formula", "table recognition: x", "stable", "代表", "LaTeX", "formula table", "", "Text Recognition: table"]
    assert [t.split()[0] for t in many(spark, rq.task_prompt(F.col("v")), texts)] == ["Table", "Table", "Table", "Table", "Formula", "Table", "Text", "Text"]


def test_request_contents(spark):
    bodies = [json.dumps({"model": "m", "stream": True, "stream_options": {"include_usage": True}, "messages": [{"role": "user", "content": "[{\"type\":\"file\"}]"}]}), "[", json.dumps({"messages": [{"role": "user", "content": [{"type": "image_url", "image_url": {"url": "u"}}]}]}), "{}"]
    r = many(spark, rq.parse_request(F.col("v")), bodies)
    assert (r[0].ok, r[0].stream, r[0].include_usage, r[0].messages[0].content, r[0].messages[0].parts) == (True, True, True, '[{"type":"file"}]', None)
    assert not r[1].ok and r[2].messages[0].parts[0].image_url.url == "u" and r[3].messages == []


def test_payload_edges(spark):
    urls = ["data:text/plain;base64,aGk=", "http://x", None, "data:text/plain;base64,@@"]
    part = F.struct(F.lit("file").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url"), F.struct(F.lit("").alias("filename"), F.col("v").alias("file_data")).alias("file"))
    got = many(spark, rq.file_payload(part), urls)
    assert (got[0].name, got[0].mime, bytes(got[0].data)) == ("document", "text/plain", b"hi") and got[1] is None and got[2] is None and got[3].data is None
    assert many(spark, rq.file_text(F.lit("n"), F.unhex("v")), ["61FF62"]) == ['File: "n"\n\na�b']
    assert many(spark, rq.file_stem(F.col("v")), ["a/b.tar.gz", ".x", "noext", "d.d/e"]) == ["b.tar", ".x", "noext", "e"]
    long = "x" * 300
    assert many(spark, rq.to_data_url(F.lit("m"), F.col("v").cast("binary")), [long])[0] == "data:m;base64," + __import__("base64").b64encode(long.encode()).decode()


def test_scan(spark):
    boxes = [[(0.0, 0.0, 5.0, 10.0)], [(-5.0, 0.0, 4.0, 10.0)], [], [(0.0, 0.0, 3.0, 10.0), (0.0, 0.0, 3.0, 10.0)]]
    df = spark.createDataFrame([(b,) for b in boxes], "b array<struct<x0:double,y0:double,x1:double,y1:double>>")
    assert [r.x for r in df.select(is_scan(F.col("b"), F.lit(10.0), F.lit(10.0)).alias("x")).collect()] == [True, False, False, True]


def test_cache(spark):
    jobs = spark.createDataFrame([("m", "p", u) for u in ("a", "a", "b")], "m string, p string, u string").withColumn("key", cache_key(F.col("m"), F.col("p"), F.col("u")))
    import hashlib
    assert jobs.first().key == hashlib.sha256(b"m\0p\0a").hexdigest()
    kept = to_keep(jobs.where("u = 'a'").withColumn("text", F.lit("T")).unionByName(jobs.where("u = 'b'").withColumn("text", F.lit("[OCR error: x]"))))
    hits, misses = with_cache(jobs, kept)
    assert [r.text for r in hits.collect()] == ["T", "T"] and [r.u for r in misses.collect()] == ["b"]


def by_hand(deltas):
    text, sent, out = "", 0, ""
    for d in deltas:
        text += d or ""
        cut = loop_begin(text)
        if cut is not None:
            text = text[:cut]
            break
        if len(text) - 600 > sent:
            out += text[sent: len(text) - 600]
            sent = len(text) - 600
    return out + text[sent:] if len(text) > sent else out


STREAMS = {"short": ["ab", None, "c"], "loop": ["x" * 50 + str(i) for i in range(30)] + ["ab"] * 400 + ["tail"], "chunk": ["head " * 100 + "no. " * 500, "more"], "long": [f"word{i} " for i in range(900)]}


def test_cut_batch(spark):
    df = spark.createDataFrame([(k, i, d) for k, ds in STREAMS.items() for i, d in enumerate(ds)], "stream_id string, seq long, delta string")
    got = {r.stream_id: r.text for r in cut_streams(df).collect()}
    assert got == {k: by_hand(v) for k, v in STREAMS.items()}
    assert len(got["loop"]) < 1700 and Cutter().finish() == ""


def test_cut_streaming(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    frames = [(k, i, d, i == len(ds) - 1) for k, ds in STREAMS.items() for i, d in enumerate(ds)]
    for n, part in enumerate((frames[:200], frames[200:])):
        (source / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("stream_id", "seq", "delta", "last"), f))) for f in part))
        os.utime(source / f"{n}.json", (time.time() + n, time.time() + n))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("stream_id string, seq long, delta string, last boolean").option("maxFilesPerTrigger", 1).json(str(source))
    query = cut_stream(stream).writeStream.format("memory").queryName("cut").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {}
    for r in spark.table("cut").orderBy("stream_id", "piece").collect():
        got[r.stream_id] = got.get(r.stream_id, "") + r.text
    assert got == {k: by_hand(v) for k, v in STREAMS.items()}


def test_pages(spark, tmp_path):
    docs = spark.createDataFrame([(1, bytearray(b"one\x0c two \x0cthree"), [2, 9]), (2, bytearray(b"a\x0cb"), None), (3, bytearray(b""), None), (4, None, None)], "doc int, data binary, asked array<bigint>")
    got = sorted((r.doc, r.page, r.page_count, r.text) for r in read_pages(docs, TextPages(), asked="asked").collect())
    assert got == [(1, 2, 3, "two"), (2, 1, 2, "a"), (2, 2, 2, "b")]
    file = tmp_path / "a.txt"
    file.write_bytes(b"one\x0ctwo")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
    df = spark.read.format("pages").option("files", json.dumps([str(file)])).load()
    assert [r.text for r in df.orderBy("page").collect()] == ["one", "two"]
    assert [r.text for r in df.where("page = 2").collect()] == ["two"]


def test_xlsx(tmp_path):
    sheets = xlsx.result_sheets(["日付", "番号"], [["1/2", "12"], ["", "012"]], [{"row": 1, "column": "番号", "kind": "補正", "detail": "a & b"}], [xlsx.table_sheet("OCR原本_P1", [["a", "b"], ["&amp;", "1.5"]], [{"r1": 0, "c1": 0, "r2": 0, "c2": 1}], {0})])
    path = tmp_path / "a.xlsx"
    xlsx.write_sheets(str(path), sheets)
    got = xlsx.read_values(str(path))
    assert got["整形済み"] == [["日付", "番号"], ["1/2", "12"], ["", "012"]] and got["OCR原本_P1"][1] == ["&", "1.5"]
    assert got["確認リスト"][1] == ["1", "番号", "補正", "a & b"]
    import xml.dom.minidom
    import zipfile
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            xml.dom.minidom.parseString(z.read(name))
        first = z.read("xl/worksheets/sheet1.xml").decode()
        assert 'state="frozen"' in first and "<v>12</v>" in first and "FFF2B3" in z.read("xl/styles.xml").decode()
    assert xlsx.sheet_title("a/b*", ["a_b_"]) == "a_b__2" and xlsx.sheet_title("", []) == "Sheet" and xlsx.sheet_title("x" * 40, []) == "x" * 28
    assert [xlsx.typed(v) for v in ("0", "12", "1.50", "0120")] == ["0", 12, 1.5, "0120"]


def test_exports(tmp_path):
    s = Settings(export_dir=str(tmp_path), public_base_url="http://h")
    link = exports.export('a/b "c"', lambda p: open(p, "w").close(), s)
    token, name = link.split("/")[-2:]
    assert name == "a_b%20_c_.xlsx" and exports.download_path(token, "a_b _c_.xlsx", s) and exports.download_path(token, ".x", s) is None and exports.download_path("x", "a", s) is None
    assert exports.prune(s, time.time() + 73 * 3600) == 1 and not (tmp_path / token).exists()
    (tmp_path / token).mkdir()
    (tmp_path / token / "a.xlsx").touch()
    (tmp_path / token / "other").touch()
    with pytest.raises(OSError):
        exports.prune(s, time.time() + 73 * 3600)


def test_entry_and_oracles(spark):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry
    from tablewright.plans import catalog
    sf = entry.SMALL
    assert catalog.FLAGSHIP in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents conversations".split():
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")

    def plain(v):
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    for name in ("format_flagship", "audit_issues", "page_hints", "convert_tables", "infer_headers", "route", "split_dates"):
        frame = catalog.QUERIES[name](spark, sf)
        result = con.execute(catalog.ORACLE_SQL[name])
        names = [c[0] for c in result.description]
        want = sorted(tuple(plain(v) for v in (row[names.index(c)] for c in sorted(names))) for row in result.fetchall())
        got = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in frame.collect())
        assert sorted(frame.columns) == sorted(names) and got == want, name


SHEETS = "name string, sheets array<struct<title:string,grid:array<array<string>>,merges:array<struct<r1:int,c1:int,r2:int,c2:int>>,header:boolean,header_rows:array<int>>>"


def test_sink_header_rows_and_names(spark, tmp_path):
    spark.dataSource.register(xlsx.XlsxSink)
    sheet = ("t", [["a", "b"], ["1", "x"], ["c", "d"]], [], True, [0, 2])
    spark.createDataFrame([("one/two", [sheet])], SHEETS).write.format("xlsx").mode("append").save(str(tmp_path / "fine"))
    with zipfile.ZipFile(tmp_path / "fine" / "one_two.xlsx") as z:
        page = z.read("xl/worksheets/sheet1.xml").decode()
    style = {ref: page.split(f'r="{ref}" s="')[1].split('"')[0] for ref in ("A1", "A2", "A3")}
    assert style["A1"] == style["A3"] != style["A2"]
    with pytest.raises(Exception, match="stand for several workbooks"):
        spark.createDataFrame([("a/b", [sheet]), ("a:b", [sheet])], SHEETS).write.format("xlsx").mode("append").save(str(tmp_path / "clash"))


def test_sink_folders(spark, tmp_path):
    spark.dataSource.register(xlsx.XlsxSink)
    sheet = ("t", [["a"], ["1"]], [], True, [0])
    made = spark.createDataFrame([(f"d{k}", [sheet]) for k in range(20)], SHEETS)
    made.write.format("xlsx").option("folders", 8).mode("append").save(str(tmp_path / "many"))
    paths = [r.path for r in xlsx.saved(spark, str(tmp_path / "many"), 8).collect()]
    assert sorted(os.path.basename(p) for p in paths) == sorted(f"d{k}.xlsx" for k in range(20)) and len({os.path.dirname(p) for p in paths}) > 1
    assert xlsx.read_values(paths[0]) == {"t": [["a"], ["1"]]}
    made.limit(0).write.format("xlsx").option("folders", 8).mode("append").save(str(tmp_path / "none"))
    assert xlsx.saved(spark, str(tmp_path / "none"), 8).count() == 0
    with pytest.raises(Exception, match="stand for several workbooks"):
        made.unionByName(made.limit(1)).write.format("xlsx").option("folders", 8).mode("append").save(str(tmp_path / "clash"))


def test_workbooks_take_few_tasks(spark):
    from tablewright.plans import audits
    sheet = ("t", [["a"], ["1"]], [], True, [0])
    books = spark.createDataFrame([(f"d{k}", [sheet]) for k in range(300)], SHEETS).coalesce(1)
    sc = spark.sparkContext
    sc.setJobGroup("workbooks", "workbooks")
    try:
        paths = {r.path for r in audits._written(spark, books).select("path").collect()}
        stages = [sc.statusTracker().getStageInfo(s) for j in sc.statusTracker().getJobIdsForGroup("workbooks") for s in sc.statusTracker().getJobInfo(j).stageIds]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(paths) == 300 and sum(s.numTasks for s in stages if s) < 100  # not a task for each path
