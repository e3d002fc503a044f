"""Inputs of the registered queries, made from the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts) -> Column:
    """Concatenation of columns and plain strings."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def joined(values: Column, by: str = ",") -> Column:
    """An array as one text (null stays null): comparable in any engine."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), by)


def pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")
