"""Column headers of tables that have none, from the types of their cells.

Grids are handled in long form, a row for each cell, so that a table of any
length is classified by ordinary aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.text import strip
from tablewright.functions.values import HEADER_WORDS, NAMES, cell_type

MATCH_RATIO, LEAST_VALUES, NAME_RATIO = 0.6, 2, 0.5


def looks_like_header(row: Column) -> Column:
    """Whether half or more of a row's filled cells are short and hold a header word."""
    filled = F.filter(row, lambda v: strip(v) != "")
    hits = F.filter(filled, lambda v: (F.length(v) <= 8) & v.rlike(HEADER_WORDS))
    return F.when(F.size(filled) > 0, F.size(hits) / F.size(filled) >= 0.5).otherwise(F.lit(False))


def long_grid(tables: DataFrame, keys: list[str], grid: str = "grid") -> DataFrame:
    """(keys, r, c, value): a row for each cell."""
    rows = tables.select(*keys, F.posexplode(grid).alias("r", "row"))
    return rows.select(*keys, "r", F.posexplode("row").alias("c", "value"))


def classify_columns(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, c, type): the type of each column (null if none) of cells (keys, r, c, value).

    The type most cells have (of equal ones, that seen first) must hold for six
    tenths of the filled cells, of which there must be two; names must be
    distinct in half of them.
    """
    v = cells.select(*keys, "c", "r", strip(F.col("value")).alias("v"))
    filled = v.where("v != ''").withColumn("type", cell_type(F.col("v")))
    by_type = filled.groupBy(*keys, "c", "type").agg(F.count("*").alias("n"), F.min("r").alias("first"))
    best = by_type.groupBy(*keys, "c").agg(F.sum("n").alias("filled"), F.max_by(F.struct("type", "n"), F.when(F.col("type").isNotNull(), F.struct(F.col("n"), -F.col("first")))).alias("best"))
    distinct = filled.groupBy(*keys, "c").agg(F.countDistinct("v").alias("kinds"))
    all_columns = cells.select(*keys, "c").distinct()
    found = all_columns.join(best, [*keys, "c"], "left").join(distinct, [*keys, "c"], "left")
    holds = (F.col("filled") >= LEAST_VALUES) & (F.col("best.n") / F.greatest("filled", F.lit(1)) >= MATCH_RATIO)
    named = F.col("best.type").isin(*NAMES) & (F.col("kinds") / F.greatest("filled", F.lit(1)) < NAME_RATIO)
    return found.select(*keys, "c", F.when(holds & ~named, F.col("best.type")).alias("type"))


def label_columns(types: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, labels): labels of each table's columns; tables without any type are left out.

    Of neighbouring short-name columns the first is 姓 and the second 名; a lone
    one, and any after the second, is 氏名. Repeated labels are numbered.
    """
    order = Window.partitionBy(*keys).orderBy("c")
    short = F.coalesce(F.col("type") == "名前", F.lit(False))
    t = types.withColumn("short", short).withColumn("any", F.max(F.col("type").isNotNull()).over(Window.partitionBy(*keys))).where("any")
    t = t.withColumn("island", F.col("c") - F.sum(F.col("short").cast("int")).over(order))
    run = Window.partitionBy(*keys, "short", "island")
    t = t.withColumn("place", F.row_number().over(run.orderBy("c"))).withColumn("size", F.count("*").over(run))
    name = F.when(F.col("size") == 1, "氏名").when(F.col("place") == 1, "姓").when(F.col("place") == 2, "名").otherwise("氏名")
    t = t.withColumn("label", F.when(F.col("short"), name).otherwise(F.coalesce("type", F.concat(F.lit("列"), (F.col("c") + 1).cast("string")))))
    t = t.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "label").orderBy("c")))
    label = F.when(F.col("k") > 1, F.concat("label", F.col("k").cast("string"))).otherwise(F.col("label"))
    pairs = F.array_sort(F.collect_list(F.struct("c", label.alias("label"))))
    return t.groupBy(*keys).agg(F.transform(pairs, lambda x: x["label"]).alias("labels"))


def infer_headers(tables: DataFrame, keys: list[str], grid: str = "grid") -> DataFrame:
    """tables with ``labels``: inferred headers; null for empty grids, grids that have a header, and unknown ones."""
    open_ = tables.where((F.size(grid) > 0) & ~looks_like_header(F.get(F.col(grid), F.lit(0))))
    labels = label_columns(classify_columns(long_grid(open_, keys, grid), keys), keys)
    return tables.join(labels, keys, "left")
