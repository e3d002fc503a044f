"""HTML tables as values: cells, and grids with their spans laid out."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

#: A table as text; one inside another ends at the inner end tag.
TABLE_PATTERN = r"(?is)<table\b.*?</table>"
#: A cell without attributes and tags inside, as most are; else a comment or a tag.
_TAG = re.compile(r"<t([dh])>([^<]*)</t\1>|<!--.*?-->|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_BLANKS = re.compile(r"[ \t]+")
MOST_SPAN = 100


def span(value: str | None) -> int:
    """A span attribute, from 1 to 100; 1 if it is no number."""
    try:
        return min(max(int(value), 1), MOST_SPAN)
    except (TypeError, ValueError):
        return 1


def attributes(markup: str) -> dict[str, str]:
    """The attributes of a start tag by name in lower case; of a repeated one the last."""
    return {name.lower(): html.unescape(value[1:-1] if value[:1] in "\"'" and value else value) for name, value in _ATTRIBUTE.findall(markup)}


def read_cells(markup: str) -> list[list[dict]]:
    """Rows of cells of one table.

    A cell counts once it is closed; one that a next cell or the end cuts short
    is lost. A cell before any row opens one. Text outside cells is dropped.
    """
    rows: list[list[dict]] = []
    cell: dict | None = None
    said: list[str] = []
    at = 0
    for tag in _TAG.finditer(markup):
        if tag[1]:
            if not rows:
                rows.append([])
            rows[-1].append({"text": _BLANKS.sub(" ", html.unescape(tag[2])).strip(), "colspan": 1, "rowspan": 1, "header": tag[1] == "h"})
            cell = None
            continue
        if cell is not None:
            said.append(html.unescape(markup[at: tag.start()]))
        at = tag.end()
        name = (tag[4] or "").lower()
        if name == "tr" and not tag[3]:
            rows.append([])
        elif name in ("td", "th"):
            if not tag[3]:
                spans = attributes(tag[5])
                cell = {"colspan": span(spans.get("colspan")), "rowspan": span(spans.get("rowspan")), "header": name == "th"}
                said = []
                if not rows:
                    rows.append([])
            elif cell is not None:
                rows[-1].append({"text": _BLANKS.sub(" ", "".join(said)).strip(), **cell})
                cell = None
        elif name == "br" and not tag[3] and cell is not None:
            said.append("\n")
    return rows


def lay_out(rows: list[list[dict]]) -> dict:
    """The dense grid of a table's cells, and the blocks that spans merge.

    Cells go to the next free place of their row; a block overwrites what it
    covers, shows its text at its first place, and may reach below the last row.
    """
    if not any(cell["rowspan"] > 1 or cell["colspan"] > 1 for row in rows or [] for cell in row):
        last = max((r for r, row in enumerate(rows or [], 1) if row), default=0)
        width = max(map(len, rows[:last]), default=0) if last else 0
        return {"grid": [[cell["text"] for cell in row] + [""] * (width - len(row)) for row in rows[:last]] if last else [], "merges": []}
    canvas: list[dict[int, str]] = []
    merges = []
    for r, row in enumerate(rows or []):
        c = 0
        for cell in row:
            height, width = cell["rowspan"], cell["colspan"]
            while len(canvas) < r + height:
                canvas.append({})
            while c in canvas[r]:
                c += 1
            for line in canvas[r: r + height]:
                line.update(dict.fromkeys(range(c, c + width), ""))
            canvas[r][c] = cell["text"]
            if height * width > 1:
                merges.append({"r1": r, "c1": c, "r2": r + height - 1, "c2": c + width - 1})
            c += width
    while canvas and not canvas[-1]:
        canvas.pop()
    width = max((max(line) + 1 for line in canvas if line), default=0)
    return {"grid": [[line.get(c, "") for c in range(width)] for line in canvas], "merges": merges}


_CELL = pa.struct([("text", pa.string()), ("colspan", pa.int32()), ("rowspan", pa.int32()), ("header", pa.bool_())])
_ROWS = pa.list_(pa.list_(_CELL))
_GRID = pa.struct([("grid", pa.list_(pa.list_(pa.string()))), ("merges", pa.list_(pa.struct([(k, pa.int32()) for k in ("r1", "c1", "r2", "c2")])))])
_READ = pa.struct([("rows", _ROWS), *_GRID])
_TABLE_TYPE, _GRID_TYPE, _READ_TYPE = from_arrow_type(_ROWS), from_arrow_type(_GRID), from_arrow_type(_READ)


@F.arrow_udf(_TABLE_TYPE)
def parse_table(markup: pa.Array) -> pa.Array:
    return pa.array([None if m is None else read_cells(m) for m in markup.to_pylist()], _ROWS)


@F.arrow_udf(_GRID_TYPE)
def table_grid(rows: pa.Array) -> pa.Array:
    return pa.array([lay_out(r) for r in rows.to_pylist()], _GRID)


@F.arrow_udf(_READ_TYPE)
def read_table(markup: pa.Array) -> pa.Array:
    """Rows (null without any), grid and merges in one pass, as of ``parse_table`` and ``table_grid``."""
    read = [None if m is None else read_cells(m) or None for m in markup.to_pylist()]
    return pa.array([{"rows": rows, **lay_out(rows)} for rows in read], _READ)


def table_texts(text: Column) -> Column:
    """All tables of a text, as written."""
    return F.regexp_extract_all(text, F.lit(TABLE_PATTERN), F.lit(0))


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def unescape_grid(grid: pa.Array) -> pa.Array:
    return pa.array([None if g is None else [[html.unescape(v) for v in row] for row in g] for g in grid.to_pylist()], pa.list_(pa.list_(pa.string())))


def grid_markdown(grid: Column) -> Column:
    """A Markdown table of a grid (entities decoded before); its first row is the head."""
    def line(row: Column) -> Column:
        cells = F.transform(row, lambda v: F.coalesce(F.nullif(F.replace(F.replace(v, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")), F.lit("")), F.lit(" ")))
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    head = F.get(grid, F.lit(0))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(head)))
    body = F.transform(F.slice(grid, F.lit(2), F.greatest(F.size(grid) - 1, F.lit(0))), line)
    return F.when(F.size(grid) > 0, F.array_join(F.concat(F.array(line(head), rule), body), "\n")).otherwise(F.lit(""))
