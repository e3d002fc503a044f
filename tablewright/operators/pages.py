"""Pages: which are read, which are scans, and their text in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.config import Settings


def selected_pages(page_count: Column, asked: Column, settings: Settings = Settings()) -> Column:
    """Page numbers (from 1) to read: those asked for that exist, else the first ones.

    Only the default is capped; an explicit choice is read whole.
    """
    there = F.filter(asked, lambda p: (p >= 1) & (p <= page_count))
    first = F.least(page_count.cast("long"), F.lit(settings.pdf_max_pages).cast("long"))
    default = F.when(first >= 1, F.sequence(F.lit(1).cast("long"), first)).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(there) > 0, there).otherwise(default)


def first_pages(pages: DataFrame, n: int, *, doc: str = "doc", page: str = "page") -> DataFrame:
    """The first n pages of every document; limits run before the shuffle."""
    from pyspark.sql import Window
    return pages.withColumn("__r", F.row_number().over(Window.partitionBy(doc).orderBy(page))).where(F.col("__r") <= n).drop("__r")


def image_cover(boxes: Column, width: Column, height: Column) -> Column:
    """Share of a page under images (boxes of x0, y0, x1, y1); overlaps count twice."""
    def area(b: Column) -> Column:
        w = F.least(b["x1"], width) - F.greatest(b["x0"], F.lit(0.0))
        h = F.least(b["y1"], height) - F.greatest(b["y0"], F.lit(0.0))
        return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))

    total = F.aggregate(F.transform(boxes, area), F.lit(0.0), lambda s, a: s + a)
    return F.when(width * height > 0, total / (width * height)).otherwise(F.lit(0.0))


def is_scan(boxes: Column, width: Column, height: Column, settings: Settings = Settings()) -> Column:
    return (width * height > 0) & (image_cover(boxes, width, height) >= settings.scan_image_coverage)


def needs_recognition(text: Column, scan: Column, settings: Settings = Settings()) -> Column:
    return F.lit(bool(settings.ocr_fallback_model)) & ((text == "") | scan)


def document_text(pages: DataFrame, *, doc: str = "doc", page: str = "page", text: str = "text", name: str = "name") -> DataFrame:
    """(doc, text): the pages of each document under headings, in order, after the file's name."""
    block = F.concat(F.lit("--- Page "), F.col(page).cast("string"), F.lit(" ---\n"), F.col(text))
    joined = pages.groupBy(doc).agg(F.max(name).alias("__n"), F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), block.alias("b")))).alias("__b"))
    return joined.select(doc, F.concat(F.lit('File: "'), F.col("__n"), F.lit('"\n\n'), F.array_join(F.transform("__b", lambda x: x["b"]), "\n\n")).alias("text"))


def page_answer(pages: DataFrame, *, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, text): recognised pages joined, with headings if there are several."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t"))))
    return pages.groupBy(doc).agg(rows.alias("r")).select(doc, F.array_join(F.transform("r", lambda x, i: F.concat(F.when(F.size("r") > 1, F.concat(F.lit("## Page "), (i + 1).cast("string"), F.lit("\n\n"))).otherwise(F.lit("")), x["t"])), "\n\n").alias("text"))
