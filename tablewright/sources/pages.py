"""Pages of documents as a data source, over any page reader.

A reader turns a document's bytes into pages; which library does it is up to
the reader. The text reader here takes form feeds as page ends; a PDF reader is
used if a library for it is installed (none is required).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from tablewright.config import Settings
from tablewright.operators.pages import selected_pages
from tablewright.operators.requests import to_data_url

PAGES = "page int, page_count int, text string, width double, height double, boxes array<struct<x0:double,y0:double,x1:double,y1:double>>, png binary"


class PageReader(Protocol):
    def count(self, data: bytes) -> int:
        """Pages of a document; 0 if it can't be read."""

    def read(self, data: bytes, pages: list[int], images: bool) -> Iterator[dict]:
        """page (from 1), text (stripped), width, height, boxes of images, png (or None)."""


class TextPages:
    """Plain text with form feeds: pages without images."""

    def count(self, data: bytes) -> int:
        return data.count(b"\f") + 1 if data else 0

    def read(self, data, pages, images):
        parts = data.decode("utf-8", "replace").split("\f")
        for p in pages:
            yield {"page": p, "text": parts[p - 1].strip(), "width": 0.0, "height": 0.0, "boxes": [], "png": None}


class PdfPages:
    """PDFs through PyMuPDF, where it is installed."""

    def __init__(self, settings: Settings = Settings()):
        self.settings = settings

    def _open(self, data: bytes):
        import fitz
        return fitz.open(stream=data, filetype="pdf")

    def count(self, data: bytes) -> int:
        with self._open(data) as pdf:
            return pdf.page_count

    def read(self, data, pages, images):
        with self._open(data) as pdf:
            for p in pages:
                page = pdf[p - 1]
                boxes = [dict(zip(("x0", "y0", "x1", "y1"), map(float, i["bbox"]))) for i in page.get_image_info()]
                png = page.get_pixmap(dpi=self.settings.pdf_dpi).tobytes("png") if images else None
                yield {"page": p, "text": page.get_text().strip(), "width": float(page.rect.width), "height": float(page.rect.height), "boxes": boxes, "png": png}


def read_pages(documents: DataFrame, reader: PageReader, *, data: str = "data", asked: str | None = None, images: bool = False, settings: Settings = Settings()) -> DataFrame:
    """A row for each page to read of each document: the other columns of documents, and PAGES.

    Pages are chosen before they are rendered: those of the array column
    ``asked`` that exist, else the first ones.
    """
    keep = [c for c in documents.columns if c != data]
    counted = documents.mapInArrow(_counter(reader, keep, data), documents.select(*keep, data).schema.add("page_count", IntegerType()))
    wanted = F.col(asked) if asked else F.lit(None).cast("array<bigint>")
    chosen = counted.withColumn("__pages", selected_pages(F.col("page_count"), wanted, settings)).where(F.size("__pages") > 0)

    def run(batches):
        for batch in batches:
            rows = {c: [] for c in (*keep, *[f.split(" ")[0] for f in ("page", "page_count", "text", "width", "height", "boxes", "png")])}
            for row in batch.to_pylist():
                for page in reader.read(row[data], row["__pages"], images):
                    for c in keep:
                        rows[c].append(row[c])
                    rows["page_count"].append(row["page_count"])
                    for c in ("page", "text", "width", "height", "boxes", "png"):
                        rows[c].append(page[c])
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([*[batch.schema.field(c) for c in keep], ("page", pa.int32()), ("page_count", pa.int32()), ("text", pa.string()), ("width", pa.float64()), ("height", pa.float64()), ("boxes", pa.list_(pa.struct([(k, pa.float64()) for k in ("x0", "y0", "x1", "y1")]))), ("png", pa.binary())]))

    schema = StructType([*documents.select(*keep).schema.fields, *StructType.fromDDL(PAGES).fields])
    return chosen.select(*keep, data, "page_count", "__pages").mapInArrow(run, schema)


def _counter(reader: PageReader, keep: list[str], data: str):
    def run(batches):
        for batch in batches:
            counts = [reader.count(d.as_py()) if d.is_valid else 0 for d in batch.column(batch.schema.get_field_index(data))]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in (*keep, data)], pa.array(counts, pa.int32())], [*keep, data, "page_count"])

    return run


def page_jobs(jobs: DataFrame, reader: PageReader, *, key: str = "doc", settings: Settings = Settings()) -> DataFrame:
    """(key, ord, page, url, prompt, source): the images of ``requests.recognition_jobs``, PDFs page by page.

    A PDF's pages are those asked for that exist, else the first ones; each is
    an image of its own. Images that came as such have page 1. Their order in a
    request is that of ord and page.
    """
    columns = [key, "ord", "page", "url", "prompt", "source"]
    images = jobs.where(F.col("kind") == "image").withColumn("page", F.lit(1))
    files = jobs.where(F.col("kind") == "pdf").select(key, "ord", "data", "pages", "prompt", "source")
    pages = read_pages(files, reader, asked="pages", images=True, settings=settings)
    return images.select(columns).unionByName(pages.withColumn("url", to_data_url(F.lit("image/png"), F.col("png"))).select(columns))


class PageSource(DataSource):
    """spark.read.format("pages").option("files", json list of paths): a row for each page.

    A filter on ``page`` reaches the reader: other pages are not rendered. That
    needs the session's spark.sql.python.filterPushdown.enabled.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return f"path string, {PAGES}"

    def reader(self, schema):
        return _PageSourceReader(self.options)


class _PageSourceReader(DataSourceReader):
    def __init__(self, options):
        self.options, self.pages = options, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("page",):
                self.pages = [f.value]
            elif isinstance(f, In) and f.attribute == ("page",):
                self.pages = list(f.value)
            else:
                yield f

    def partitions(self):
        return [InputPartition(p) for p in json.loads(self.options.get("files", "[]"))]

    def read(self, partition):
        reader = PdfPages() if partition.value.lower().endswith(".pdf") else TextPages()
        with open(partition.value, "rb") as f:
            data = f.read()
        n = reader.count(data)
        pages = [p for p in (self.pages or range(1, n + 1)) if 1 <= p <= n]
        for p in reader.read(data, pages, self.options.get("images", "false") == "true"):
            yield (partition.value, p["page"], n, p["text"], p["width"], p["height"], [tuple(b.values()) for b in p["boxes"]], p["png"])
