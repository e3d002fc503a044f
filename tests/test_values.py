"""Rules for values, against examples and plain Python."""

import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.config import Settings
from tablewright.functions import text as tx
from tablewright.functions import values as vl
from tablewright.operators.audit import lost_characters


def one(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} string" for k in inputs))
    return row.select(column.alias("x")).first().x


def many(spark, column, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", column.alias("x")).orderBy("i").collect()]


def test_settings():
    s = Settings.from_mapping({"OCR_MODELS": "a, b,", "PDF_DPI": "72", "TABLE_AUTO_HEADER": "no", "FORMAT_LLM": " x ", "PUBLIC_BASE_URL": "http://h/"})
    assert (s.ocr_models, s.pdf_dpi, s.table_auto_header, s.format_llm, s.public_base_url) == (("a", "b"), 72, False, "x", "http://h")
    assert Settings() == Settings.from_mapping({})


def test_kinds(spark):
    names = ["受付日付", "birth DATE", "〒", "Zip", "携帯", "hotel", "住所", None]
    assert many(spark, vl.column_kind(F.col("v")), names)[:7] == ["date", "date", "postal", "postal", "phone", "phone", None]
    assert [vl.kind_of(n) for n in names[:7]] == ["date", "date", "postal", "postal", "phone", "phone", None]


def test_template(spark):
    got = many(spark, vl.parse_template(F.col("v"), ["d"]), ["ok\n列: 氏名, 住所、 電話/〒\nend", "Columns：a", "column: ,", "none", None])
    assert got == [["氏名", "住所", "電話", "〒"], ["a"], ["d"], ["d"], ["d"]]


def test_tidy_and_problem(spark):
    def both(kind, values):
        normal = [unicodedata.normalize("NFKC", v) for v in values]
        tidy = many(spark, vl.tidy(F.col("v"), kind), normal)
        return list(zip(tidy, [p is None for p in many(spark, vl.problem(F.col("v"), kind), tidy)]))

    assert both("date", ["2026年7月6日", " 7 ／ 6", "７・６", "13/2", "2/30", "abc", ""]) == [("2026/7/6", True), ("7/6", True), ("7/6", True), ("13/2", False), ("2/30", True), ("abc", False), ("", True)]
    assert both("postal", ["〒 123-4567", "1234567", "12-345"]) == [("123-4567", True), ("123-4567", True), ("12-345", False)]
    assert both("phone", ["０３ - １２３４ - ５６７８", "0901234567", "090-123-45"]) == [("03-1234-5678", True), ("0901234567", True), ("090-123-45", False)]
    assert both(None, [" x "]) == [("x", True)]


def test_cell_types(spark):
    got = many(spark, vl.cell_type(F.col("v")), ["〒 123 - 4567", "03-1234-5678", "1/2", "R6.1.2", "令和6年1月2日", "東京都港区1-2", "山田 太郎", "山田太郎", "山田", "word", "", " 12・3 x"])
    assert got == ["郵便番号", "電話番号", "日付", "日付", "日付", "住所", "氏名", "氏名", "名前", None, None, "日付"]


def test_split_dates(spark):
    rows = spark.createDataFrame([(["12/5K12/8T", "", "1・2"],), (["２０２６/07/06"],), ([],), (["x", "3.4 memo"],)], "raw array<string>")
    got = [tuple(r.s) for r in tx.nfkc_arrays(rows, v="raw").select(vl.split_dates(F.col("v")).alias("s")).collect()]
    assert got == [("12/5", ["K", "12/8T", "1/2"]), ("26/7", ["20 /06"]), ("", []), ("3/4", ["x", "m", "emo"])]


def test_typed_and_width(spark):
    values = ["0", "0120", "-5", "1" * 15, "1" * 16, "007.5", "1.", "山a", ""]
    assert many(spark, vl.typed_kind(F.col("v")), values) == ["string", "string", "int", "int", "string", "float", "string", "string", "string"]
    assert many(spark, tx.display_width(F.col("v")), ["山a", "", "ｱ"]) == [3, 0, 2]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=12).filter(lambda t: "\x00" not in t and t.isprintable()), min_size=1, max_size=30))
def test_nfkc_is_pythons(spark, values):
    assert many(spark, tx.nfkc("v"), values) == [unicodedata.normalize("NFKC", v) for v in values]


def test_strip_is_pythons(spark):
    values = ["　 a b\x1c", "\t\n", "", "x ", " y"]
    assert many(spark, tx.strip(F.col("v")), values) == [v.strip() for v in values]


def test_canon(spark):
    assert many(spark, vl.canon(tx.nfkc("v")), ["サーバ", "Ａ－１ (b)、，", "12/5"]) == ["サバ", "a1b", "125"]


def test_lost_characters(spark):
    row = spark.createDataFrame([("aabbc1é", "abé"), ("ab", "ba"), ("", "x"), ("aa", "")], "s string, o string")
    assert [r.x for r in row.select(lost_characters(F.col("s"), F.col("o")).alias("x")).collect()] == ["1abc", "", "", "aa"]


def loop_by_hand(text):
    tail = text[-600:]
    for k in range(1, 61):
        n = 0
        while len(tail) - (n + 1) * k >= 0 and tail[len(tail) - (n + 1) * k: len(tail) - n * k] == tail[-k:]:
            n += 1
        if n >= 10 and n * k >= 300:
            m = n
            while len(text) - (m + 1) * k >= 0 and text[len(text) - (m + 1) * k: len(text) - m * k] == text[-k:]:
                m += 1
            return k, len(text) - m * k
    return None, None


def test_loops(spark):
    unit61 = "".join(chr(65 + i % 26) + str(i) for i in range(40))[:61]
    texts = ["x" * 299, "x" * 300, "ab" + "xyz" * 400, "q" + unit61[:60] * 10, unit61 * 10, "q" + "abcdefg" * 43 + "!", "head " + ": [t]" * 90, "a" * 5, "", "ab" * 200 + "a"]
    want = [loop_by_hand(t) for t in texts]
    assert many(spark, tx.trailing_loop(F.col("v")), texts) == [k for k, _ in want]
    assert many(spark, tx.loop_start("v"), texts) == [s for _, s in want]
    assert many(spark, tx.trailing_loop(F.col("v")), [None]) == [None]
