"""Mapping source rows to a template's columns through a reshaping service.

The service is injected: anything with ``reshape(template, columns, rows)``.
Batches keep their composition (it is part of what the service sees); one that
fails is dropped, and its rows fall back later. ``RuleReshaper`` is a
deterministic stand-in, which moves values by header and by content.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.config import NOTES, Settings
from tablewright.functions.values import CELL_TYPES, is_date, kind_of
from tablewright.operators.merge import batch_of, value_of


#: What a service raises that refuses, can't be reached, or answers in no form that can be read.
NO_ANSWER = (RuntimeError, OSError, ValueError)


class Reshaper(Protocol):
    """One output row (with its src) for each input row; values only from the row.

    A call without an answer raises one of NO_ANSWER; other errors are faults,
    and end the job.
    """

    def reshape(self, template: list[str], columns: list[str], rows: list[tuple[int, list[str]]]) -> list[dict]:
        ...


class RuleReshaper:
    """Values by equal header, then by the type that a template column's name asks for."""

    #: Types of cells that a column of a kind or name takes.
    TAKES = {"postal": ("郵便番号",), "phone": ("電話番号",), "date": ("日付",), "住所": ("住所",), "氏名": ("氏名", "名前"), "名前": ("氏名", "名前")}

    def __init__(self):
        self.types = [(name, re.compile(pattern)) for name, pattern in CELL_TYPES]

    def _type(self, value: str) -> str | None:
        v = value.strip()
        return next((name for name, pattern in self.types if pattern.search(v)), None)

    def reshape(self, template, columns, rows):
        return [{"src": src, **self._row(template, columns, values)} for src, values in rows]

    def _row(self, template: list[str], columns: list[str], values: list[str]) -> dict[str, str]:
        left = {c: v for c, v in zip(columns, values) if v}
        out = {c: left.pop(c, "") for c in template if c != NOTES}
        for c in [c for c, v in out.items() if not v]:
            takes = self.TAKES.get(kind_of(c) or c, ())
            found = next((k for k, v in left.items() if self._type(v) in takes), None)
            if found is not None:
                out[c] = left.pop(found)
        if "姓" in out and "名" in out and not out["姓"] and not out["名"]:
            found = next((k for k, v in left.items() if self._type(v) == "氏名" and " " in v.strip()), None)
            if found is not None:
                out["姓"], out["名"] = left.pop(found).strip().split(None, 1)
        notes = left.pop(NOTES, "")
        return out | {NOTES: " ".join(x for x in (notes, *left.values()) if x)}


def date_rule(template: list[str], columns: Column) -> Column:
    """Whether dates are filled by rule: template and source have a date column each."""
    return F.lit(any(kind_of(c) == "date" for c in template)) & F.coalesce(F.exists(columns, is_date), F.lit(False))


def reshape(source: DataFrame, columns: DataFrame, template: list[str], service: Reshaper, *, doc: str = "doc", settings: Settings = Settings()) -> DataFrame:
    """(doc, src, values): what the service made of each source row.

    ``source`` is of ``merge.source_rows``, ``columns`` of ``source_columns``.
    Where dates go by rule, the service sees neither the template's date columns
    nor the source's. Answers for rows outside their batch are dropped; of
    repeated answers for a row the last one counts.
    """
    by_rule = date_rule(template, F.col("columns"))
    seen = F.when(by_rule, F.filter("columns", lambda c: ~is_date(c))).otherwise(F.col("columns"))
    asked = source.join(columns, doc).select(doc, F.col("idx"), batch_of(F.col("idx"), settings.format_batch_rows).alias("batch"), by_rule.alias("by_rule"), seen.alias("columns"), F.transform(seen, lambda c: value_of(F.col("cells"), c)).alias("values"))
    no_dates = [c for c in template if kind_of(c) != "date"]
    # A row for each batch (of a bounded number of rows): calls need no grouping in Python.
    batches_ = asked.groupBy(doc, "batch").agg(F.first("by_rule").alias("by_rule"), F.first("columns").alias("columns"), F.array_sort(F.collect_list(F.struct("idx", "values"))).alias("rows"))
    kind = source.schema[doc].dataType

    def run(batches):
        for batch in batches:
            at, srcs, values = [], [], []
            for k, call in enumerate(batch.select(["by_rule", "columns", "rows"]).to_pylist()):
                rows = [(r["idx"], r["values"]) for r in call["rows"]]
                wanted = {src for src, _ in rows}
                try:
                    answers = list(service.reshape(no_dates if call["by_rule"] else list(template), call["columns"], rows))
                except NO_ANSWER:  # costs this batch's rows only; they fall back
                    answers = []
                for src, a in {a["src"]: a for a in answers if a.get("src") in wanted}.items():
                    at.append(k)
                    srcs.append(src)
                    values.append([(str(c), "" if v is None else str(v)) for c, v in a.items() if c != "src"])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(srcs, pa.int64()), pa.array(values, pa.map_(pa.string(), pa.string()))], [doc, "src", "values"])

    return batches_.mapInArrow(run, f"`{doc}` {kind.simpleString()}, src long, values map<string,string>")


def last_answers(answers: DataFrame, *, doc: str = "doc", src: str = "src", at: str = "pos") -> DataFrame:
    """Of several answers for a row the last one (by ``at``)."""
    return answers.groupBy(doc, src).agg(F.max_by("values", at).alias("values"))


def parse_answer(answer: Column, template: Iterable[str]) -> Column:
    """A service's JSON answer as an array of rows; null if it isn't one."""
    from tablewright.schema import reshaped_rows
    return F.from_json(answer, reshaped_rows(list(template), NOTES))["rows"]
