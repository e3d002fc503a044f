"""All registered queries of the table engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright.plans import audits, cells, chat

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "format_flagship"

for _group in (chat.ALL, cells.ALL, audits.ALL):
    for _name, (_query, _sql) in _group.items():
        QUERIES[_name] = _query
        if _sql:
            ORACLE_SQL[_name] = _sql
