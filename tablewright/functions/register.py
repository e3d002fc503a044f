"""SQL names for the functions that Spark lacks."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tablewright.functions.cells import TABLE_PATTERN, lay_out, parse_table, read_cells, table_grid, unescape_grid
from tablewright.functions.text import html_unescape, loop_start, nfkc


class HtmlCells:
    """html_cells(text): a row for each place of each table's grid."""

    def eval(self, text: str):
        import re
        for n, found in enumerate(re.finditer(TABLE_PATTERN, text or "")):
            for r, row in enumerate(lay_out(read_cells(found[0]))["grid"]):
                for c, value in enumerate(row):
                    yield n, r, c, value


def register(spark: SparkSession) -> None:
    """Makes nfkc, html_unescape, loop_start, parse_table, table_grid, unescape_grid and html_cells known to SQL."""
    for name, function in (("nfkc", nfkc), ("html_unescape", html_unescape), ("loop_start", loop_start), ("parse_table", parse_table), ("table_grid", table_grid), ("unescape_grid", unescape_grid)):
        spark.udf.register(name, function)
    spark.udtf.register("html_cells", udtf(HtmlCells, returnType="table_no int, r int, c int, value string"))
