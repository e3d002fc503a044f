"""Merging the tables of a document's pages into one relation of named values.

Headers differ from table to table, so rows stay arrays of header and value (in
order); only the template's columns are spread out, last of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.text import strip


def header_names(grid: Column, header: Column) -> Column:
    """A table's column names: its header row with blanks filled, or 列1, 列2, …"""
    first = F.get(grid, F.lit(0))
    numbered = F.transform(first, lambda v, i: F.concat(F.lit("列"), (i + 1).cast("string")))
    return F.when(header, F.transform(first, lambda v, i: F.when(v == "", F.concat(F.lit("列"), (i + 1).cast("string"))).otherwise(v))).otherwise(numbered)


def named_cells(names: Column, values: Column) -> Column:
    """Header and value by position; of a repeated header the first place and the last value."""
    order = F.array_distinct(names)
    pairs = F.arrays_zip(names.alias("n"), values.alias("v"))

    def last(h: Column) -> Column:
        same = F.filter(pairs, lambda p: p["n"] == h)
        return F.get(same, F.size(same) - 1)["v"]

    return F.transform(order, lambda h: F.struct(h.alias("header"), last(h).alias("value")))


def source_rows(tables: DataFrame, *, doc: str = "doc", page: str = "page") -> DataFrame:
    """(doc, idx, page, cells): all rows of a document's tables, numbered from 0.

    ``tables`` has doc, page, table_no, grid and header. Rows that are blank,
    and rows that repeat their own table's header, are left out. Numbers are
    within a document: a window over documents, never one over all rows.
    """
    t = tables.where(F.size("grid") > 0).withColumn("names", header_names(F.col("grid"), F.col("header")))
    body = F.when(F.col("header"), F.slice("grid", 2, F.greatest(F.size("grid") - 1, F.lit(0)))).otherwise(F.col("grid"))
    rows = t.select(doc, page, "table_no", "names", F.posexplode(body).alias("r", "row"))
    rows = rows.where(F.exists("row", lambda v: strip(v) != "") & (F.col("row") != F.col("names")))
    numbered = rows.withColumn("idx", F.row_number().over(Window.partitionBy(doc).orderBy(page, "table_no", "r")) - 1)
    return numbered.select(doc, F.col("idx").cast("long"), page, named_cells(F.col("names"), F.col("row")).alias("cells"))


def source_columns(tables: DataFrame, *, doc: str = "doc", page: str = "page") -> DataFrame:
    """(doc, columns): the union of the tables' headers, in the order first seen."""
    t = tables.where(F.size("grid") > 0).select(doc, page, "table_no", F.posexplode(header_names(F.col("grid"), F.col("header"))).alias("c", "name"))
    first = t.groupBy(doc, "name").agg(F.min(F.struct(F.col(page).alias("p"), F.col("table_no").alias("t"), "c")).alias("at"))
    return first.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("columns"))


def value_of(cells: Column, name: Column) -> Column:
    """A row's value under a header, '' if it has none."""
    return F.coalesce(F.get(F.filter(cells, lambda c: c["header"] == name), F.lit(0))["value"], F.lit(""))


def row_text(cells: Column) -> Column:
    return F.array_join(F.filter(F.transform(cells, lambda c: c["value"]), lambda v: v != ""), " ")


def batch_of(idx: Column, size: int) -> Column:
    """The batch of a numbered row: fixed sizes, in order."""
    return F.floor(idx / size).cast("long")
