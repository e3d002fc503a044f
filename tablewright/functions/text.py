"""Text expressions. All are built-in Spark functions, but for Unicode normalisation."""

from __future__ import annotations

import html
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode has it, with the four separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"
#: Full-width digits, for casts after a match.
_WIDE, _PLAIN = "０１２３４５６７８９", "0123456789"


def _normal(values: pa.Array) -> pa.Array:
    # Not pyarrow's normalisation: its NFKC leaves characters decomposed.
    return pa.array([v if v is None or v.isascii() else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def nfkc(values: pa.Array) -> pa.Array:
    """Compatibility normalisation (NFKC)."""
    return _normal(values)


def nfkc_arrays(df: DataFrame, **outputs: str) -> DataFrame:
    """Adds NFKC forms of array<string> columns: nfkc_arrays(df, out="column").

    One pass over Python for all values of a row. A pass over the rows, not a
    function of a column: higher-order functions may then read its result.
    """
    schema = T.StructType([*df.schema.fields, *[T.StructField(out, T.ArrayType(T.StringType())) for out in outputs]])

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            for name in outputs.values():
                values = batch.column(batch.schema.get_field_index(name))
                sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                flat = _normal(values.flatten())
                columns.append(pa.ListArray.from_arrays(offsets, flat, mask=values.is_null() if values.null_count else None))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *outputs])

    return df.mapInArrow(run, schema)


@F.pandas_udf(T.StringType())
def html_unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else html.unescape(v))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+", "")


def number(c: Column) -> Column:
    """A run of decimal digits, full-width ones too, as a long (null if it is none)."""
    return F.translate(c, _WIDE, _PLAIN).try_cast("long")


def display_width(c: Column) -> Column:
    """Columns on a screen: code points above U+2E7F count twice."""
    return (F.length(c) + F.length(F.regexp_replace(c, r"[^\x{2E80}-\x{10FFFF}]", ""))).cast("int")


def trailing_loop(c: Column, *, span: int = 300, count: int = 10, unit: int = 60) -> Column:
    """Length of the shortest unit that the text's end repeats back to back, or null.

    A loop has ``count`` repeats and ``span`` characters or more, within the
    last 2 * span characters. The tail is bound once as a lambda's variable:
    as a plain column it would be computed anew for every unit. Units are tried
    only where the last ``unit`` characters also stand up to ``unit`` characters
    earlier, as they do at the end of every loop.
    """
    def first_unit(tail: Column) -> Column:
        units = F.transform(
            F.sequence(F.lit(1), F.lit(unit)),
            lambda k: F.struct(k.alias("k"), F.greatest(F.lit(count), F.ceil(F.lit(span) / k).cast("int")).alias("n")))
        looped = F.filter(units, lambda u: (F.length(tail) >= u["k"] * u["n"]) & (F.call_function("right", tail, u["k"] * u["n"]) == F.call_function("repeat", F.call_function("right", tail, u["k"]), u["n"])))
        found = F.get(looped, F.lit(0))["k"]
        if span < 2 * unit:
            return found
        again = F.call_function("instr", F.call_function("right", tail, F.lit(2 * unit)), F.call_function("right", tail, F.lit(unit)))
        return F.when(again <= unit, found)

    return F.get(F.transform(F.array(F.call_function("right", c, F.lit(2 * span))), first_unit), F.lit(0))


def loop_begin(text: str, *, span: int = 300, count: int = 10, unit: int = 60) -> int | None:
    """Where a text's trailing loop begins (its first copy included), or None.

    The shortest unit counts that fills the last ``span`` characters or more
    with ``count`` repeats or more, within the last 2 * span characters.
    """
    tail = text[-2 * span:]
    # A loop's last characters stand a unit earlier, too: one search tells most texts apart.
    if len(tail) < span or (span >= 2 * unit and tail[-2 * unit:].find(tail[-unit:]) == unit):
        return None
    for k in range(1, min(unit, len(tail)) + 1):
        need = k * max(count, -(-span // k))
        if len(tail) >= need and tail[-need:-k] == tail[k - need:]:
            at = len(text) - need
            while at >= k and text[at - k: at] == text[-k:]:
                at -= k
            return at
    return None


@F.arrow_udf(T.IntegerType())
def loop_start(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else loop_begin(t) for t in text.to_pylist()], pa.int32())
