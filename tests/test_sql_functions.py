"""Functions under their SQL names, and expressions that the queries don't reach."""

from pyspark.sql import functions as F

from tablewright.functions.register import register
from tablewright.operators.report import progress_lines
from tablewright.operators.tables import sheet_titles


def test_sql_names(spark):
    register(spark)
    r = spark.sql("SELECT nfkc('ﾊﾞ１') AS a, html_unescape('&lt;') AS b, loop_start(concat('q', repeat('ab', 200))) AS c, table_grid(parse_table('<tr><td>x</td></tr>')).grid AS d").first()
    assert (r.a, r.b, r.c, r.d) == ("バ1", "<", 1, [["x"]])
    rows = spark.sql("SELECT * FROM html_cells('a <table><tr><td colspan=2>x</td></tr><tr><td>y</td></tr></table>')").collect()
    assert [tuple(x) for x in rows] == [(0, 0, 0, "x"), (0, 0, 1, ""), (0, 1, 0, "y"), (0, 1, 1, "")]
    assert spark.sql("SELECT * FROM html_cells(CAST(NULL AS STRING))").count() == 0


def test_titles(spark):
    df = spark.createDataFrame([(1, "a:b"), (2, "a/b"), (3, ""), (4, "x" * 40)], "k int, name string").withColumn("book", F.lit(1))
    assert [r.title for r in sheet_titles(df, ["book"], "name", "k").orderBy("k").collect()] == ["a_b", "a_b_2", "Sheet", "x" * 28]


def test_progress(spark):
    pages = spark.createDataFrame([(1, 1, 2, 7)], "doc int, page int, tables int, rows int")
    batches = spark.createDataFrame([(1, 0, 15), (1, 1, 2)], "doc int, batch long, rows int")
    assert [r.line for r in progress_lines(pages, batches).orderBy("seq").collect()] == ["- page 1: 2 tables, about 7 rows", "- batch 1/2: 15 rows", "- batch 2/2: 2 rows"]
