"""Rules for the values of table cells: kinds, canonical forms, formats, types."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.text import SPACE, number, strip, without_space

# The words that tell a column's kind, first match first.
KINDS = (("date", "日付|年月日|日時|date"), ("postal", "郵便|〒|zip|postal"), ("phone", "電話|tel|phone|携帯"))
# Characters that a canonical form leaves out, besides white space.
IGNORED = "・/.-ー－()（）,、"
# Ideographs of names and places.
KANJI = "一-鿿々ヶ"
KANA = r"ぁ-んァ-ン"
# The types of cells, first match first.
CELL_TYPES = (
    ("郵便番号", rf"^〒?{SPACE}*\d{{3}}{SPACE}*-{SPACE}*\d{{4}}$"),
    ("電話番号", rf"(?<!\d)0\d{{1,4}}{SPACE}*[-(（)）]{SPACE}*\d{{1,4}}{SPACE}*-?{SPACE}*\d{{3,8}}(?!\d)|(?<!\d)0\d{{9,10}}(?!\d)"),
    ("日付", rf"^(?:(?:\d{{4}}|[RHSrhs令平昭]\w{{0,2}}\d{{1,2}}){SPACE}*[/／.．年-]{SPACE}*)?\d{{1,2}}{SPACE}*[/／・.．月]{SPACE}*\d{{1,2}}(?!\d)"),
    ("住所", rf"^(?:東京都|北海道|(?:京都|大阪)府|[{KANJI}]{{2,3}}県)?[{KANJI}{KANA}]{{1,6}}[市区郡町村].*\d"),
    ("氏名", rf"^[{KANJI}]{{2,3}}{SPACE}+[{KANJI}]{{1,3}}$|^[{KANJI}]{{4,6}}$"),
    ("名前", rf"^[{KANJI}]{{1,3}}$"),
)
#: Short names, which need distinct values to count as names.
NAMES = ("名前", "氏名")
# Words of a header row.
HEADER_WORDS = r"日付|年月日|氏名|名前|姓|名|郵便|〒|住所|所在地|電話|TEL|tel|番号|備考|No\.?$"
# A date token of a ledger: month, day, and perhaps a letter.
DATE_TOKEN = rf"(?U)(\d{{1,2}}){SPACE}*[/・.．]{SPACE}*(\d{{1,2}})(?!\d){SPACE}*([A-Za-z]?)"


def kind_of(name: str) -> str | None:
    """A column name's kind, for templates known to the driver."""
    return next((kind for kind, words in KINDS if re.search(words, name, re.IGNORECASE)), None)


def column_kind(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, words in reversed(KINDS):
        out = F.when(c.rlike(f"(?iu){words}"), F.lit(kind)).otherwise(out)
    return out


def is_date(c: Column) -> Column:
    return c.rlike(f"(?iu){KINDS[0][1]}")


def canon(normal: Column) -> Column:
    """What is compared of a value (given in NFKC): lower case, no spaces and marks."""
    return F.regexp_replace(F.lower(normal), "(?U)[" + SPACE[1:-1] + re.escape(IGNORED) + "]", "")


def tidy(normal: Column, kind: str | None) -> Column:
    """A value (given in NFKC) in the format of its column's kind."""
    v = strip(normal)
    if kind == "date":
        day = rf"(?U)^(\d{{1,4}}){SPACE}*[/・.年-]{SPACE}*(\d{{1,2}})(?:{SPACE}*[/・.月-]{SPACE}*(\d{{1,2}}))?{SPACE}*日?\z"
        groups = F.filter(F.array(*[F.regexp_extract(v, day, k) for k in (1, 2, 3)]), lambda g: g != "")
        return F.when(v.rlike(day), F.array_join(groups, "/")).otherwise(v)
    if kind == "postal":
        digits = F.regexp_replace(v, r"(?U)\D", "")
        return F.when(F.length(digits) == 7, F.concat(F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 4))).otherwise(v)
    if kind == "phone":
        return without_space(v)
    return v


def problem(value: Column, kind: str | None) -> Column:
    """Why a value is not valid in its column, or null."""
    none = F.lit(None).cast("string")
    if kind == "date":
        parts = F.split(value, "/")
        month, day = number(F.get(parts, F.size(parts) - 2)), number(F.get(parts, F.size(parts) - 1))
        fine = value.rlike(r"(?U)^\d{1,4}(?:/\d{1,2}){1,2}\z") & month.between(1, 12) & day.between(1, 31)
        text = "not a month and day"
    elif kind == "postal":
        fine, text = value.rlike(r"(?U)^\d{3}-\d{4}\z"), "not a postal code of 3 and 4 digits"
    elif kind == "phone":
        fine, text = value.rlike(r"(?U)^(?:0\d{1,4}-\d{1,4}-\d{3,4}|0\d{9,10})\z"), "not a telephone number"
    else:
        return none
    return F.when((value != "") & ~F.coalesce(fine, F.lit(False)), F.lit(text)).otherwise(none)


def cell_type(c: Column) -> Column:
    """The first of CELL_TYPES that a stripped value shows, or null."""
    v, out = strip(c), F.lit(None).cast("string")
    for name, pattern in reversed(CELL_TYPES):
        out = F.when(v.rlike(f"(?U){pattern}"), F.lit(name)).otherwise(out)
    return out


def typed_kind(c: Column) -> Column:
    """'int', 'float' or 'string': what a spreadsheet cell holds. Codes stay text."""
    return (F.when(c.rlike(r"^-?[1-9]\d{0,14}\z"), F.lit("int")).when(c.rlike(r"(?U)^-?\d+\.\d+\z"), F.lit("float")).otherwise(F.lit("string")))


def typed_number(c: Column) -> Column:
    return F.when(typed_kind(c) != "string", c.try_cast("double"))


def parse_template(c: Column, default: list[str] | tuple[str, ...]) -> Column:
    """The columns that a chat text asks for ("columns: a, b"), or the default."""
    named = F.regexp_extract(c, r"(?iuU)(?:列|項目|columns?)\s*[:：]\s*([^\n]+)", 1)
    found = F.filter(F.transform(F.split(named, "[,、，/／]"), strip), lambda x: x != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(x) for x in default]))


def date_tokens(normal: Column) -> Column:
    """Date tokens of a value (given in NFKC): structs of date (M/D) and code (a letter or '')."""
    def group(token: Column, k: int) -> Column:
        return F.regexp_extract(token, DATE_TOKEN, k)

    def date(token: Column) -> Column:
        return F.concat(number(group(token, 1)).cast("string"), F.lit("/"), number(group(token, 2)).cast("string"))

    # A token alone is matched as it was in its value: the long text is searched once.
    found = F.regexp_extract_all(normal, F.lit(DATE_TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.struct(date(t).alias("date"), group(t, 3).alias("code")))


def date_rest(normal: Column) -> Column:
    """What is left of a value (given in NFKC) without its date tokens."""
    return F.regexp_replace(F.regexp_replace(normal, DATE_TOKEN, " "), r"^[ ・,、]+|[ ・,、]+\z", "")


def split_dates(normal_values: Column) -> Column:
    """struct<first, notes> of a row's date columns (values in NFKC, in order).

    The first date of all goes to first, its code to notes; later dates with
    their codes, and what else the values hold, go to notes, in order.
    """
    values = F.transform(normal_values, lambda v: F.struct(date_tokens(v).alias("tokens"), date_rest(v).alias("rest")))
    # Bound as a lambda's variable: a plain column would be computed for each use.
    return F.get(F.transform(F.array(values), _first_and_notes), F.lit(0))


def _first_and_notes(values: Column) -> Column:
    dates = F.flatten(F.transform(values, lambda t: t["tokens"]))
    first = F.coalesce(F.get(dates, F.lit(0))["date"], F.lit(""))
    lead = F.array_position(F.transform(values, lambda t: F.size(t["tokens"]) > 0), F.lit(True)) - 1

    def notes(t: Column, i: Column) -> Column:
        said = F.transform(t["tokens"], lambda d, j: F.when((i == lead) & (j == 0), d["code"]).otherwise(F.concat(d["date"], d["code"])))
        return F.filter(F.concat(said, F.array(t["rest"])), lambda x: x != "")

    return F.struct(first.alias("first"), F.flatten(F.transform(values, notes)).alias("notes"))
