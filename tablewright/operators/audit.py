"""Checking reshaped rows against their source rows.

Everything but the two joins is a projection over one row; NFKC is applied to
a row's dates in one pass over Python, and to all its values in another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.config import MARKS, NOTES
from tablewright.functions.text import nfkc_arrays, strip
from tablewright.functions.values import canon, is_date, kind_of, problem, split_dates, tidy
from tablewright.operators.merge import row_text, value_of
from tablewright.operators.reshape import date_rule

FIXED, DOUBT, LOST, RAW = MARKS


def lost_characters(source: Column, output: Column) -> Column:
    """ASCII letters and digits of one canonical text that the other has fewer of, sorted.

    Most rows lose nothing, which comparing the sorted characters tells; only
    the others are counted letter by letter.
    """
    def letters(text: Column) -> Column:
        return F.regexp_replace(text, "[^0-9a-z]", "")

    def times(text: Column, ch: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, ch, F.lit("")))

    def lost(both: Column) -> Column:
        same = F.array_sort(F.split(both["s"], "")) == F.array_sort(F.split(both["o"], ""))
        chars = F.array_sort(F.array_distinct(F.split(both["s"], "")))
        counted = F.transform(chars, lambda ch: F.when(ch != "", F.call_function("repeat", ch, F.greatest(F.lit(0), times(both["s"], ch) - times(both["o"], ch)))).otherwise(F.lit("")))
        return F.when(same, F.lit("")).otherwise(F.array_join(counted, ""))

    # Bound once by a lambda: as plain columns both would be computed for each use.
    return F.get(F.transform(F.array(F.struct(letters(source).alias("s"), letters(output).alias("o"))), lost), F.lit(0))


def audit(source: DataFrame, shaped: DataFrame, template: list[str], columns: DataFrame, *, doc: str = "doc") -> DataFrame:
    """(doc, n, columns, values, issues) for every source row, n from 1.

    Steps: dates by rule (the first date to the template's first date column,
    the rest to the notes); a notes column where the template has none and any
    row of the document has notes; values in their column's format; issues in
    the order they are found: a row without an answer (its source values are
    used), per column a value that is not in the source row and a value that is
    not valid, and characters of the source row that are in no value.
    """
    named = shaped.select(F.col(doc).alias("__d"), F.col("src").alias("__s"), F.col("values").alias("shaped"))
    rows = source.join(named, (F.col(doc) == F.col("__d")) & (F.col("idx") == F.col("__s")), "left").drop("__d", "__s").join(columns, doc, "left")
    answered = F.col("shaped").isNotNull()
    by_rule = answered & date_rule(template, F.col("columns"))
    dated = F.transform(F.filter("cells", lambda c: is_date(c["header"]) & (strip(c["value"]) != "")), lambda c: c["value"])
    rows = nfkc_arrays(rows.withColumn("dated", F.when(by_rule, dated).otherwise(F.array().cast("array<string>"))), dates="dated")
    rows = rows.withColumn("split", split_dates(F.col("dates")))
    given = F.coalesce(F.get(F.filter(F.array(F.try_element_at("shaped", F.lit(NOTES))), lambda x: x.isNotNull()), F.lit(0)), F.lit(""))
    notes = F.when(by_rule, F.array_join(F.filter(F.concat(F.col("split.notes"), F.array(given)), lambda x: x != ""), ", ")).otherwise(given)
    rows = rows.withColumn("notes", notes)
    first_date = next((c for c in template if kind_of(c) == "date"), None)
    used = F.lit(False) if NOTES in template else F.max(F.col("notes") != "").over(Window.partitionBy(doc))
    rows = rows.withColumn("notes_used", used)

    def raw(c: str) -> Column:
        shaped = F.coalesce(F.try_element_at("shaped", F.lit(c)), F.lit(""))
        if c == NOTES:
            shaped = F.col("notes")
        elif c == first_date:
            shaped = F.when(by_rule, F.col("split.first")).otherwise(shaped)
        return F.when(answered, shaped).otherwise(value_of(F.col("cells"), F.lit(c)))

    names = list(template) + ([] if NOTES in template else [NOTES])
    text = row_text(F.col("cells"))
    rows = nfkc_arrays(rows.select(doc, "idx", "notes_used", answered.alias("answered"), text.alias("text"), F.array(text, *[raw(c) for c in names]).alias("raw")), normal="raw")
    normal = F.col("normal")
    values = [tidy(F.get(normal, F.lit(k + 1)), kind_of(c)) for k, c in enumerate(names)]
    kept = F.when(F.col("notes_used") | F.lit(NOTES in template), F.lit(len(names))).otherwise(F.lit(len(template)))
    rows = rows.select(doc, "idx", "text", "notes_used", "answered", canon(F.get(normal, F.lit(0))).alias("canon"), F.slice(F.array(*values), F.lit(1), kept).alias("values"), F.slice(F.array(*[F.lit(c) for c in names]), F.lit(1), kept).alias("columns"))

    def issue(column: Column, kind: str, detail: Column) -> Column:
        return F.struct(column.alias("column"), F.lit(kind).alias("kind"), detail.alias("detail"))

    nothing = F.lit(None).cast("struct<column:string,kind:string,detail:string>")
    def for_once(value: Column, make) -> Column:
        return F.get(F.transform(F.array(value), make), F.lit(0))

    def fixed(c: str):
        return lambda own: F.when((own != "") & ~F.contains(F.col("canon"), own), issue(F.lit(c), FIXED, F.concat(F.lit("source row: "), F.col("text"))))

    def doubtful(c: str):
        return lambda wrong: F.when(wrong.isNotNull(), issue(F.lit(c), DOUBT, wrong))

    found = [F.when(~F.col("answered"), issue(F.get("columns", F.lit(0)), RAW, F.lit("no answer for this row: its source values are shown")))]
    for k, c in enumerate(names):
        v = F.get("values", F.lit(k))  # null for a notes column that isn't used
        found.append(for_once(canon(v), fixed(c)))
        if kind_of(c):
            found.append(for_once(problem(v, kind_of(c)), doubtful(c)))
    lost = lost_characters(F.col("canon"), canon(F.array_join("values", " ")))
    found.append(for_once(lost, lambda l: F.when(l != "", issue(F.element_at("columns", -1), LOST, F.concat(F.lit("not found in the row: "), l, F.lit(" (source row: "), F.col("text"), F.lit(")"))))))
    issues = F.filter(F.array(*[F.coalesce(f, nothing) for f in found]), lambda x: x.isNotNull())
    return rows.select(doc, (F.col("idx") + 1).alias("n"), "columns", "values", issues.alias("issues"))


def issue_rows(audited: DataFrame, *, doc: str = "doc") -> DataFrame:
    """(doc, n, seq, column, kind, detail): issues in the order they were found within a document's row."""
    # Outer: else a filter on the issues' number is inferred, which computes them twice.
    return audited.select(doc, "n", F.posexplode_outer("issues").alias("seq", "issue")).where("issue is not null").select(doc, "n", "seq", "issue.column", "issue.kind", "issue.detail")


def template_rows(audited: DataFrame, names: list[str], *, doc: str = "doc") -> DataFrame:
    """(doc, n, one column for each name): the rows spread out."""
    at = [F.get("values", F.array_position("columns", F.lit(c)).cast("int") - 1) for c in names]
    there = [F.when(F.array_contains("columns", c), v) for c, v in zip(names, at)]
    return audited.select(doc, "n", *[v.alias(c) for c, v in zip(names, there)])
