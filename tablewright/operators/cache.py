"""Recognised text by content: a table instead of a cache in one process."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that begin like this are failures and are not kept.
ERROR = "[OCR error"


def cache_key(model: Column, prompt: Column, url: Column) -> Column:
    nul = F.char(F.lit(0))
    return F.sha2(F.concat(model, nul, prompt, nul, url).cast("binary"), 256)


def with_cache(jobs: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(jobs whose text is known, with ``text``; jobs to recognise, each key once)."""
    known = cache.select(F.col("key").alias("__k"), F.col("text")).dropDuplicates(["__k"])
    hits = jobs.join(known, F.col(key) == F.col("__k")).drop("__k")
    misses = jobs.join(known, F.col(key) == F.col("__k"), "left_anti").dropDuplicates([key])
    return hits, misses


def to_keep(recognised: DataFrame) -> DataFrame:
    """Rows (key, text) that the cache takes: all but failures."""
    return recognised.where(~F.startswith("text", F.lit(ERROR))).select("key", "text").dropDuplicates(["key"])


def newest(cache: DataFrame, n: int, at: str = "used") -> DataFrame:
    """The n entries used last, where a cache must stay small."""
    return cache.orderBy(F.desc(at), "key").limit(n)
