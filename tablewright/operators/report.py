"""Results as text: Markdown of rows with their marks, issue lists, answers in chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.config import MARKS
from tablewright.operators.tables import header_rows, sheet_names


def _mark(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, mark in MARKS.items():
        out = F.when(kind == name, F.lit(mark)).otherwise(out)
    return out


def marked_values(audited: DataFrame) -> DataFrame:
    """Adds ``shown``: the values as Markdown cells; the last issue of a cell marks it."""
    def cell(v: Column, i: Column) -> Column:
        here = F.filter("issues", lambda x: x["column"] == F.get("columns", i))
        mark = _mark(F.get(here, F.size(here) - 1)["kind"])
        text = F.replace(F.replace(v, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
        return F.when(mark.isNull(), F.when(text == "", F.lit(" ")).otherwise(text)).when(text == "", mark).otherwise(F.concat(text, F.lit(" "), mark))

    return audited.withColumn("shown", F.transform("values", cell))


def result_markdown(audited: DataFrame, *, doc: str = "doc") -> DataFrame:
    """(doc, markdown): each document's rows as one table, numbered from 1."""
    line = F.concat(F.lit("| "), F.col("n").cast("string"), F.lit(" | "), F.array_join("shown", " | "), F.lit(" |"))
    rows = marked_values(audited).groupBy(doc).agg(F.max("columns").alias("columns"), F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("lines"))
    head = F.concat(F.lit("| # | "), F.array_join("columns", " | "), F.lit(" |"))
    rule = F.concat(F.lit("|---|"), F.repeat(F.lit("---|"), F.size("columns")))
    return rows.select(doc, F.array_join(F.concat(F.array(head, rule), F.transform("lines", lambda x: x["line"])), "\n").alias("markdown"))


def issues_markdown(issues: DataFrame, documents: DataFrame, *, doc: str = "doc", limit: int = 40) -> DataFrame:
    """(doc, markdown): the first issues of each document as a list, and how many more there are.

    The limit is applied before lines are gathered: no document's issues are
    collected whole.
    """
    from pyspark.sql import Window
    ranked = issues.withColumn("k", F.row_number().over(Window.partitionBy(doc).orderBy("n", "seq"))).where(F.col("k") <= limit)
    line = F.concat(F.lit("- row "), F.col("n").cast("string"), F.lit(" "), F.col("column"), F.lit(" "), _mark(F.col("kind")), F.lit(" "), F.col("kind"), F.lit(": "), F.col("detail"))
    first = ranked.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("lines"))
    count = issues.groupBy(doc).agg(F.count("*").alias("total"))
    more = F.when(F.col("total") > limit, F.array(F.concat(F.lit("- and "), (F.col("total") - limit).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(F.transform("lines", lambda x: x["line"]), more), "\n")
    return documents.select(doc).distinct().join(first, doc, "left").join(count, doc, "left").select(doc, F.coalesce(text, F.lit("Nothing to check.")).alias("markdown"))


def issue_counts(issues: DataFrame, documents: DataFrame, *, doc: str = "doc") -> DataFrame:
    """(doc, summary): issues by kind in their fixed order, kinds without any left out."""
    per = issues.groupBy(doc).agg(*[F.sum((F.col("kind") == k).cast("int")).alias(f"k{i}") for i, k in enumerate(MARKS)])
    said = F.filter(F.array(*[F.when(F.col(f"k{i}") > 0, F.concat(F.lit(f"{k} "), F.col(f"k{i}").cast("string"), F.lit("件"))) for i, k in enumerate(MARKS)]), lambda x: x.isNotNull())
    return documents.select(doc).distinct().join(per, doc, "left").select(doc, F.coalesce(F.nullif(F.array_join(said, "・"), F.lit("")), F.lit("なし")).alias("summary"))


def workbooks(audited: DataFrame, tables: DataFrame, *, doc: str = "doc") -> DataFrame:
    """(doc, result, sheets): what the spreadsheet sink needs for a workbook of each document.

    result: columns, rows and issues of the audited rows, in order. sheets: the
    document's tables as they were recognised (doc, page, table_no, rows, grid,
    merges, header), those without a row left out (null if there is none). A workbook is one row, as it
    is one file; documents are spread over tasks.
    """
    row = F.array_sort(F.collect_list(F.struct("n", "values", "issues")))
    listed = F.flatten(F.transform("r", lambda x: F.transform(x["issues"], lambda i: F.struct(x["n"].cast("int").alias("row"), i["column"].alias("column"), i["kind"].alias("kind"), i["detail"].alias("detail")))))
    result = F.struct("columns", F.transform("r", lambda x: x["values"]).alias("rows"), listed.alias("issues"))
    results = audited.groupBy(doc).agg(F.max("columns").alias("columns"), row.alias("r")).select(doc, result.alias("result"))
    named = sheet_names(tables.where(F.size("grid") > 0), [doc, "page"], prefix="P")
    sheet = F.struct(F.concat(F.lit("OCR原本_"), "sheet").alias("title"), "grid", "merges", "header", header_rows(F.col("rows")).alias("header_rows"))
    originals = named.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page", "table_no", sheet.alias("s")))).alias("l"))
    return results.join(originals, doc, "left").select(doc, "result", F.transform("l", lambda x: x["s"]).alias("sheets"))


def progress_lines(pages: DataFrame, batches: DataFrame, *, doc: str = "doc") -> DataFrame:
    """(doc, seq, line): a line for each page read and for each batch shaped, in order.

    ``pages`` has doc, page, tables and rows, ``batches`` doc, batch (from 0) and rows.
    """
    from pyspark.sql import Window
    read = pages.select(doc, F.col("page").cast("long").alias("seq"), F.concat(F.lit("- page "), F.col("page").cast("string"), F.lit(": "), F.col("tables").cast("string"), F.lit(" tables, about "), F.col("rows").cast("string"), F.lit(" rows")).alias("line"))
    total = F.count("*").over(Window.partitionBy(doc))
    shaped = batches.select(doc, (F.col("batch") + 1_000_000).cast("long").alias("seq"), F.concat(F.lit("- batch "), (F.col("batch") + 1).cast("string"), F.lit("/"), total.cast("string"), F.lit(": "), F.col("rows").cast("string"), F.lit(" rows")).alias("line"))
    return read.unionByName(shaped)


def usage_totals(events: DataFrame, *, key: str = "doc", usage: str = "usage") -> DataFrame:
    """(key, prompt_tokens, completion_tokens, total_tokens): sums of the three counters."""
    names = ("prompt_tokens", "completion_tokens", "total_tokens")
    return events.groupBy(key).agg(*[F.coalesce(F.sum(F.col(f"{usage}.{n}")), F.lit(0)).cast("long").alias(n) for n in names])


def _chunk(doc: Column, created: Column, model: Column, choices: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(F.struct(doc.alias("id"), F.lit("chat.completion.chunk").alias("object"), created.alias("created"), model.alias("model"), choices.alias("choices"))), F.lit("\n\n"))


def stream_answer(pieces: DataFrame, *, doc: str = "doc", seq: str = "seq", text: str = "text", model: str = "model", created: str = "created", include_usage: str = "include_usage", usage: str = "usage") -> DataFrame:
    """(doc, answer): an answer's pieces as server-sent events, in order.

    ``pieces`` has doc, seq, text, model, created, include_usage and usage.
    """
    first = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(text).alias("t"))))
    g = pieces.groupBy(doc).agg(first.alias("p"), *[F.first(c).alias(c) for c in (model, created, include_usage, usage)])
    d, m, at = F.col(doc).cast("string"), F.col(model), F.col(created)

    def choice(delta: Column, finish: Column) -> Column:
        return F.array(F.struct(F.lit(0).alias("index"), delta.alias("delta"), finish.alias("finish_reason")))

    start = _chunk(d, at, m, choice(F.struct(F.lit("assistant").alias("role"), F.lit("").alias("content")), F.lit(None).cast("string")))
    body = F.transform("p", lambda x: _chunk(d, at, m, choice(F.struct(x["t"].alias("content")), F.lit(None).cast("string"))))
    stop = _chunk(d, at, m, choice(F.struct(F.lit(None).cast("string").alias("content")), F.lit("stop")))
    used = F.concat(F.lit("data: "), F.to_json(F.struct(d.alias("id"), F.lit("chat.completion.chunk").alias("object"), at.alias("created"), m.alias("model"), F.array().cast("array<string>").alias("choices"), F.col(usage).alias("usage"))), F.lit("\n\n"))
    parts = F.concat(F.array(start), body, F.array(stop), F.when(F.col(include_usage), F.array(used)).otherwise(F.array().cast("array<string>")), F.array(F.lit("data: [DONE]\n\n")))
    return g.select(doc, F.array_join(parts, "").alias("answer"))


def full_answer(pieces: DataFrame, *, doc: str = "doc", seq: str = "seq", text: str = "text", model: str = "model", created: str = "created", usage: str = "usage") -> DataFrame:
    """(doc, answer): an answer's pieces as one completion."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(text).alias("t"))))
    g = pieces.groupBy(doc).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("c"), *[F.first(c).alias(c) for c in (model, created, usage)])
    message = F.struct(F.lit("assistant").alias("role"), F.col("c").alias("content"))
    body = F.struct(F.col(doc).cast("string").alias("id"), F.lit("chat.completion").alias("object"), F.col(created).alias("created"), F.col(model).alias("model"), F.array(F.struct(F.lit(0).alias("index"), message.alias("message"), F.lit("stop").alias("finish_reason"))).alias("choices"), F.col(usage).alias("usage"))
    return g.select(doc, F.to_json(body).alias("answer"))
