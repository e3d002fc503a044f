"""Tables in recognised text: found, read, given headers, and written as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.config import Settings
from tablewright.functions.cells import TABLE_PATTERN, grid_markdown, read_table, table_texts, unescape_grid
from tablewright.functions.text import strip
from tablewright.operators.headers import infer_headers


def extract_tables(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, table_no, markup, rows, grid, merges, header): a row for each table of each text.

    header: whether all cells of the first row are header cells (a first row
    without cells counts). Tables without any row have null rows.
    """
    found = texts.select(*keys, F.posexplode(table_texts(F.col(text))).alias("table_no", "markup"))
    found = found.withColumn("laid", read_table("markup")).withColumn("rows", F.col("laid.rows"))
    return found.select(*keys, "table_no", "markup", "rows", F.col("laid.grid").alias("grid"), F.col("laid.merges").alias("merges"), header_row(F.col("rows")).alias("header"))


def header_row(rows: Column) -> Column:
    return F.when(F.size(rows) > 0, F.forall(F.get(rows, F.lit(0)), lambda c: c["header"])).otherwise(F.lit(False))


def header_rows(rows: Column) -> Column:
    """Positions (from 0) of the rows that have cells, and only header cells."""
    def place(row: Column, i: Column) -> Column:
        return F.when((F.size(row) > 0) & F.forall(row, lambda c: c["header"]), i)

    return F.filter(F.transform(rows, place), lambda i: i.isNotNull())


def add_headers(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Tables that lack a header get an inferred one as their first row, where one is found.

    keys name the text; with table_no they name the table. What cells were
    marked as headers before are data then, and merged blocks move down by one.
    """
    found = infer_headers(tables, [*keys, "table_no"])
    new = F.col("labels").isNotNull()
    plain = F.transform("rows", lambda row: F.transform(row, lambda c: c.withField("header", F.lit(False))))
    first = F.array(F.transform("labels", lambda v: F.struct(v.alias("text"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan"), F.lit(True).alias("header"))))
    down = F.transform("merges", lambda m: F.struct((m["r1"] + 1).alias("r1"), m["c1"].alias("c1"), (m["r2"] + 1).alias("r2"), m["c2"].alias("c2")))
    return found.select(
        *keys, "table_no", "markup", F.when(new, F.concat(first, plain)).otherwise(F.col("rows")).alias("rows"),
        F.when(new, F.concat(F.array("labels"), F.col("grid"))).otherwise(F.col("grid")).alias("grid"),
        F.when(new, down).otherwise(F.col("merges")).alias("merges"), (new | F.col("header")).alias("header"), new.alias("inferred"))


def table_markdown(tables: DataFrame) -> DataFrame:
    """Adds ``markdown`` (entities are decoded once more, as in the cells of a sheet)."""
    return tables.withColumn("markdown", grid_markdown(unescape_grid("grid")))


def convert_tables(texts: DataFrame, keys: list[str], text: str = "text", settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(texts with each table as Markdown, tables).

    Texts: (keys, text), stripped; every table with a row stands between blank
    lines, one without stays as written. Tables: as of ``extract_tables`` or
    ``add_headers``, without those that have no row.
    """
    tables = extract_tables(texts, keys, text)
    full = tables.where("rows is not null")
    full = add_headers(full, keys) if settings.table_auto_header else full
    shown = table_markdown(full).select(*keys, "table_no", F.concat(F.lit("\n\n"), "markdown", F.lit("\n\n")).alias("shown"))
    kept = tables.where("rows is null").select(*keys, "table_no", F.col("markup").alias("shown"))
    pieces = shown.unionByName(kept).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("table_no", "shown"))).alias("shown"))
    joined = texts.select(*keys, F.col(text).alias("text")).join(pieces, keys, "left")
    between = F.split("text", TABLE_PATTERN, -1)
    whole = F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(F.col("shown"), i)["shown"], F.lit("")))), "")
    return joined.select(*keys, strip(whole).alias("text")), full


def sheet_names(tables: DataFrame, keys: list[str], page: str = "page", prefix: str = "Page") -> DataFrame:
    """Adds ``sheet``: the page's number after a prefix, and a number where a page has several tables."""
    from pyspark.sql import Window
    own = Window.partitionBy(*keys)
    n, k = F.count("*").over(own), F.row_number().over(own.orderBy("table_no"))
    name = F.concat(F.lit(prefix), F.col(page).cast("string"), F.when(n > 1, F.concat(F.lit("_"), k.cast("string"))).otherwise(F.lit("")))
    return tables.withColumn("sheet", name)


def row_estimate(tables: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tables, rows): tables of each page, and their rows but for one each."""
    return tables.groupBy(*keys).agg(F.count("*").alias("tables"), F.sum(F.greatest(F.size("rows") - 1, F.lit(0))).alias("rows"))


def sheet_titles(names: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """Adds ``title``: names as spreadsheets allow them, numbered where they would repeat.

    Numbers go up in order within keys, as long as no name is itself a numbered
    one (``sinks.xlsx.sheet_title`` settles that for one workbook).
    """
    from pyspark.sql import Window
    base = F.coalesce(F.nullif(F.substring(F.translate(name, "[]:*?/\\", "_______"), 1, 28), F.lit("")), F.lit("Sheet"))
    k = F.row_number().over(Window.partitionBy(*keys, "__base").orderBy(order))
    return names.withColumn("__base", base).withColumn("title", F.when(k > 1, F.concat("__base", F.lit("_"), k.cast("string"))).otherwise(F.col("__base"))).drop("__base")
