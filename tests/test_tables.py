"""HTML tables: cells, grids, headers, Markdown, merging."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.functions.cells import lay_out, read_cells
from tablewright.operators.headers import infer_headers, looks_like_header
from tablewright.operators.merge import source_columns, source_rows
from tablewright.operators.tables import add_headers, convert_tables, extract_tables, sheet_names


def texts(rows):
    return [[c["text"] for c in r] for r in rows]


def test_cells():
    assert texts(read_cells("<table><tr><td>a  \t b</td><TH>c<br>d &lt;</th></tr></table>")) == [["a b", "c\nd <"]]
    assert texts(read_cells("<td>a</td><td>b")) == [["a"]]
    assert texts(read_cells("<tr><td>lost<td>kept</td>x</tr>")) == [["kept"]]
    assert texts(read_cells("<tr></tr><tr><td><b>x</b><!-- y --></td></tr>")) == [[], ["x"]]
    cell = read_cells("<tr><td colspan=500 rowspan='x'>a</td></tr>")[0][0]
    assert (cell["colspan"], cell["rowspan"], cell["header"]) == (100, 1, False)
    assert read_cells("<table></table>") == []
    assert texts(read_cells("<tr><td>&amp;lt;</td></tr>")) == [["&lt;"]]


def cell(text, colspan=1, rowspan=1):
    return {"text": text, "colspan": colspan, "rowspan": rowspan, "header": False}


def test_grid():
    laid = lay_out([[cell("a", 2)], [cell("b", 1, 3), cell("c")]])
    assert laid["grid"] == [["a", ""], ["b", "c"], ["", ""], ["", ""]]
    assert laid["merges"] == [{"r1": 0, "c1": 0, "r2": 0, "c2": 1}, {"r1": 1, "c1": 0, "r2": 3, "c2": 0}]
    assert lay_out([]) == {"grid": [], "merges": []} and lay_out([[]]) == {"grid": [], "merges": []}
    # A block covers a place that is taken: the later one is seen.
    over = lay_out([[cell("a"), cell("b", 1, 2)], [cell("wide", 2)]])
    assert over["grid"] == [["a", "b"], ["wide", ""]]
    assert lay_out([[], [cell("x")]])["grid"] == [[""], ["x"]]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4).flatmap(lambda w: st.lists(st.lists(st.text("ab <&|\n", max_size=4).map(lambda t: t.strip(" \n")), min_size=w, max_size=w), min_size=1, max_size=5)))
def test_rows_through_html(rows):
    import html
    import re
    plain = [[re.sub(r" +", " ", v) for v in r] for r in rows]
    markup = "<table>" + "".join("<tr>" + "".join(f"<td>{html.escape(v).replace(chr(10), '<br>')}</td>" for v in r) + "</tr>" for r in plain) + "</table>"
    assert lay_out(read_cells(markup))["grid"] == plain


LEDGER = [["7/1", "信金", "山田", "太郎", "100-0001", "東京都港区1-2", "03-1234-5678"], ["7/2", "信金", "佐藤", "花子", "100-0002", "大阪府堺市3", "06-1234-5678"], ["7/3", "信金", "鈴木", "一", "100-0003", "堺市9", "090-123-4567"]]


def test_infer_headers(spark):
    grids = [LEDGER, [["日付", "氏名", "x"], ["1/2", "山田", "y"]], [["山田 太郎", "R6.1.2"], ["佐藤 花子", "令和6.2.3"]], [["foo", "1"], ["bar", "2"]], [], [["山田", "佐藤", "鈴木", "高橋"], ["木村", "林", "森", "原"]], [["1/2", "3/4"], ["5/6", "7/8"]], [["1/2"]]]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(grids)], "id int, grid array<array<string>>")
    got = {r.id: r.labels for r in infer_headers(df, ["id"]).collect()}
    assert got[0] == ["日付", "列2", "姓", "名", "郵便番号", "住所", "電話番号"]
    assert got[1] is None and got[3] is None and got[4] is None and got[7] is None
    assert got[2] == ["氏名", "日付"]
    assert got[5] == ["姓", "名", "氏名", "氏名2"]
    assert got[6] == ["日付", "日付2"]


def test_classifier_edges(spark):
    from tablewright.operators.headers import classify_columns, long_grid
    tie = [["山田"], ["1/2"], ["佐藤"], ["3/4"]]          # half each: no type holds
    six = [["1/2"], ["3/4"], ["5/6"], ["x"], ["y"]]       # six tenths
    same = [["山田"], ["山田"], ["山田"], [""]]           # names must differ
    half = [["山田"], ["山田"], ["佐藤"], ["佐藤"]]       # half of them do
    df = spark.createDataFrame([(i, g) for i, g in enumerate([tie, six, same, half])], "id int, grid array<array<string>>")
    got = {r.id: r.type for r in classify_columns(long_grid(df, ["id"]), ["id"]).collect()}
    assert got == {0: None, 1: "日付", 2: None, 3: "名前"}


def test_looks_like_header(spark):
    rows = [["日付", "x"], ["a", "b", "氏名"], ["", " "], ["とても長い日付の見出し", "x"], ["No.", "No"]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r array<string>")
    assert [x.h for x in df.select("i", looks_like_header(F.col("r")).alias("h")).orderBy("i").collect()] == [True, False, False, False, True]


def test_convert(spark):
    markup = "before <table><tr><th colspan=2>A|B</th></tr><tr><td rowspan=2>x<br>y</td><td>1</td></tr><tr><td></td></tr></table> mid <TABLE></TABLE> end "
    df = spark.createDataFrame([(1, markup), (2, "no table"), (3, None)], "doc int, text string")
    out, tables = convert_tables(df, ["doc"])
    got = {r.doc: r.text for r in out.collect()}
    assert got[1] == "before \n\n| A\\|B |   |\n|---|---|\n| x<br>y | 1 |\n|   |   |\n\n mid <TABLE></TABLE> end"
    assert got[2] == "no table" and got[3] is None
    row = tables.collect()
    assert len(row) == 1 and [tuple(m) for m in row[0].merges] == [(0, 0, 0, 1), (1, 0, 2, 0)]


def test_add_headers_and_names(spark):
    html = "<table>" + "".join("<tr>" + "".join(f"<th>{v}</th>" for v in r) + "</tr>" for r in LEDGER) + "</table>"
    df = spark.createDataFrame([(1, html + html), (2, "<table><tr><td>a</td></tr></table>")], "page int, text string")
    t = add_headers(extract_tables(df, ["page"]), ["page"])
    rows = sorted(sheet_names(t, ["page"]).collect(), key=lambda r: (r.page, r.table_no))
    assert [r.sheet for r in rows] == ["Page1_1", "Page1_2", "Page2"]
    assert rows[0].grid[0][0] == "日付" and rows[0].inferred and rows[0].header and not rows[0].rows[1][0].header
    assert not rows[2].inferred


def test_merge(spark):
    tables = [
        (1, 1, 0, [["番号", "番号", ""], ["a", "b", "c"], ["番号", "番号", "列3"], [" ", "", "　"]], True),
        (1, 2, 0, [["x", "y"]], False), (1, 2, 1, [["追加"], ["z"]], True), (2, 1, 0, [], True)]
    df = spark.createDataFrame(tables, "doc int, page int, table_no int, grid array<array<string>>, header boolean")
    rows = source_rows(df).orderBy("idx").collect()
    assert [(r.idx, r.page, [tuple(c) for c in r.cells]) for r in rows] == [(0, 1, [("番号", "b"), ("列3", "c")]), (1, 2, [("列1", "x"), ("列2", "y")]), (2, 2, [("追加", "z")])]
    assert [r.columns for r in source_columns(df).collect()] == [["番号", "列3", "列1", "列2", "追加"]]


def test_span_attributes_are_read_as_attributes():
    from tablewright.functions.cells import attributes, read_cells
    assert attributes(""" colspan=2 data-colspan="5" title='rowspan=4' COLSPAN="3" hidden""") == {"colspan": "3", "data-colspan": "5", "title": "rowspan=4", "hidden": ""}
    row = read_cells("""<tr><td data-colspan="5">a</td><td title="rowspan=4">b</td><td colspan=2 colspan=3>c</td><td rowspan="x">d</td></tr>""")[0]
    assert [(c["colspan"], c["rowspan"]) for c in row] == [(1, 1), (1, 1), (3, 1), (1, 1)]


def test_an_expired_export_beside_other_files_stops_pruning(tmp_path):
    import pytest

    from tablewright.config import Settings
    from tablewright.sinks import exports
    s = Settings(export_dir=str(tmp_path / "e"))
    assert exports.prune(s) == 0
    links = [exports.export("a", lambda p: open(p, "w").close(), s) for _ in range(2)]
    assert len(exports.listing(s)) == 2 and exports.prune(s) == 0
    (tmp_path / "e" / links[0].split("/")[-2] / "other").touch()
    with pytest.raises(OSError):
        exports.prune(s, 1e12)
    assert len(exports.listing(s)) == 2


def test_plain_cells_read_like_others():
    plain = "<table><tr><th>a</th></tr><tr><td> x  &amp; y\n</td><td></td></tr><tr></tr></table>"
    with_attributes = plain.replace("<td>", "<td id='1'>").replace("<th>", "<TH>")
    assert read_cells(plain) == read_cells(with_attributes) and lay_out(read_cells(plain)) == {"grid": [["a", ""], ["x & y", ""]], "merges": []}
    assert texts(read_cells("<td>lost<td>kept</td><td>b</th><td>c</td>")) == [["kept", "b", "c"]]


def test_tables_are_read_in_one_pass(spark):
    pages = spark.createDataFrame([(1, "<table><tr><td colspan=2>a</td></tr></table> and <table></table>")], "doc int, text string")
    found = extract_tables(pages, ["doc"])
    assert [(r.table_no, r.rows is None, r.grid, len(r.merges)) for r in found.orderBy("table_no").collect()] == [(0, False, [["a", ""]], 1), (1, True, [], 0)]
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
