"""The list of models, with the workflow's virtual one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.config import Settings


def model_list(models: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """models (id, owned_by) and, where a formatting model is set, the workflow as one more row."""
    base = models.select("id", "owned_by")
    if not settings.format_llm:
        return base
    one = base.sparkSession.range(1).select(F.lit(settings.format_model_name).alias("id"), F.lit("workflow").alias("owned_by"))
    return base.unionByName(one)


def tag_list(models: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """models (name, size, digest) and, where a formatting model is set, the workflow as one more row."""
    base = models.select("name", "size", "digest")
    if not settings.format_llm:
        return base
    one = base.sparkSession.range(1).select(F.lit(settings.format_model_name).alias("name"), F.lit(0).cast("long").alias("size"), F.lit("").alias("digest"))
    return base.unionByName(one)
