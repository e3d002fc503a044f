"""Reshaping and audit, from tables to issues."""

import pytest
from pyspark.sql import functions as F

from tablewright.config import NOTES, Settings
from tablewright.operators import report
from tablewright.operators.audit import audit, issue_rows, template_rows
from tablewright.operators.reshape import RuleReshaper, parse_answer, reshape

SOURCE = "doc int, idx long, page int, cells array<struct<header:string,value:string>>"
SHAPED = "doc int, src long, values map<string,string>"


def run(spark, template, rows, shaped, columns=None):
    source = spark.createDataFrame([(1, i, 1, list(r.items())) for i, r in enumerate(rows)], SOURCE)
    cols = spark.createDataFrame([(1, columns or list(dict.fromkeys(k for r in rows for k in r)))], "doc int, columns array<string>")
    out = spark.createDataFrame([(1, i, v) for i, v in shaped.items()], SHAPED)
    return audit(source, out, template, cols)


def issues(a):
    return [(r.n, r.column, r.kind) for r in issue_rows(a).orderBy("n", "seq").collect()]


def test_corrections_and_omissions(spark):
    template = ["日付", "住所", NOTES]
    row = {"日付": "12/5K", "住所": "東京都港区1-2", "記号": "Z9"}
    a = run(spark, template, [row], {0: {"住所": "東京都湊区1-2", NOTES: ""}})
    first = a.collect()[0]
    assert list(first["values"]) == ["12/5", "東京都湊区1-2", "K"]
    assert issues(a) == [(1, "住所", "補正"), (1, NOTES, "欠落の可能性")]
    assert "9z" in first.issues[1].detail


def test_missing_answer(spark):
    a = run(spark, ["日付"], [{"日付": "13/1"}], {})
    assert list(a.collect()[0]["values"]) == ["13/1"]
    assert issues(a) == [(1, "日付", "未整形"), (1, "日付", "要確認")]


def test_notes_column_is_added(spark):
    rows = [{"日付": "1/2 3/4T", "名": "a"}, {"日付": "5/6", "名": "b"}]
    a = run(spark, ["日付", "名"], rows, {0: {"名": "a"}, 1: {"名": "b"}})
    got = a.orderBy("n").collect()
    assert list(got[0].columns) == ["日付", "名", NOTES] and list(got[0]["values"]) == ["1/2", "a", "3/4T"] and list(got[1]["values"]) == ["5/6", "b", ""]
    spread = template_rows(a, ["名", NOTES, "no"]).orderBy("n").collect()
    assert (spread[0]["名"], spread[0][NOTES], spread[0]["no"]) == ("a", "3/4T", None)


def test_padded_date_is_flagged(spark):
    a = run(spark, ["日付", "x"], [{"日付": "08/05", "x": "q"}], {0: {"x": "q"}})
    assert list(a.collect()[0]["values"]) == ["8/5", "q"]
    assert issues(a) == [(1, "日付", "補正"), (1, "x", "欠落の可能性")]


def test_value_across_cells_and_null(spark):
    a = run(spark, ["x", "y"], [{"a": "AB", "b": "cd"}], {0: {"x": "bc", "y": None}})
    assert issues(a) == [(1, "y", "欠落の可能性")]


def test_reports(spark):
    a = run(spark, ["日付", "x|y"], [{"日付": "1/2", "x|y": "q"}, {"日付": "99/1", "x|y": "a|b"}], {0: {"x|y": "Z"}})
    text = report.result_markdown(a).collect()[0].markdown.split("\n")
    assert text == ["| # | 日付 | x|y |", "|---|---|---|", "| 1 | 1/2 | Z ⚠ |", "| 2 | 99/1 ⚠ | a\\|b |"]
    rows = issue_rows(a)
    assert report.issue_counts(rows, a).collect()[0].summary == "補正 1件・要確認 1件・欠落の可能性 1件・未整形 1件"
    listed = report.issues_markdown(rows, a, limit=3).collect()[0].markdown.split("\n")
    assert len(listed) == 4 and listed[0].startswith("- row 1 x|y ✎ 補正") and listed[3] == "- and 1 more"
    assert report.issues_markdown(rows.where("false"), a).collect()[0].markdown == "Nothing to check."


class Faulty(RuleReshaper):
    def reshape(self, template, columns, rows):
        if any(v[0] == "bad" for _, v in rows):
            raise RuntimeError("no answer")
        assert "日付" not in template and "日付" not in columns
        return super().reshape(template, columns, rows) + [{"src": 99, "x": "other batch"}, {"src": rows[0][0], "x": "last", NOTES: "n"}]


def test_reshape_batches(spark):
    rows = [(1, i, 1, [("x", "bad" if i == 4 else f"v{i}"), ("日付", "1/2")]) for i in range(6)]
    source = spark.createDataFrame(rows, SOURCE)
    columns = spark.createDataFrame([(1, ["x", "日付"])], "doc int, columns array<string>")
    got = {r.src: dict(r["values"]) for r in reshape(source, columns, ["日付", "x"], Faulty(), settings=Settings(format_batch_rows=2)).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    assert got[0] == {"x": "last", NOTES: "n"} and got[1]["x"] == "v1"


def test_rule_reshaper():
    out = RuleReshaper().reshape(["姓", "名", "郵便番号", "住所", NOTES], ["a", "b", "c", "d"], [(7, ["山田 太郎", "100-0001", "東京都港区1", "memo"])])
    assert out == [{"src": 7, "姓": "山田", "名": "太郎", "郵便番号": "100-0001", "住所": "東京都港区1", NOTES: "memo"}]


def test_parse_answer(spark):
    df = spark.createDataFrame([('{"rows":[{"src":3,"a":"x"}]}',), ("{bad",)], "j string")
    got = [r.x for r in df.select(parse_answer(F.col("j"), ["a"]).alias("x")).collect()]
    assert (got[0][0].src, got[0][0].a, got[1]) == (3, "x", None)


class Broken(RuleReshaper):
    def reshape(self, template, columns, rows):
        raise KeyError("a fault of the service's code")


def test_faults_of_a_service_end_the_job(spark):
    cells = [{"header": "x", "value": "1"}]
    source = spark.createDataFrame([(1, 0, cells)], "doc long, idx long, cells array<struct<header:string,value:string>>")
    columns = spark.createDataFrame([(1, ["x"])], "doc long, columns array<string>")
    with pytest.raises(Exception, match="a fault of the service"):
        reshape(source, columns, ["x"], Broken()).collect()
