"""Registration of queries next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def _bigint_counts(sql: str) -> str:
    """``count_if`` gives HUGEINT in DuckDB; Spark counts are BIGINT."""
    out, rest = "", sql
    while "count_if(" in rest:
        head, rest = rest.split("count_if(", 1)
        depth = end = 1
        for end, ch in enumerate(rest, start=1):
            depth += (ch == "(") - (ch == ")")
            if depth == 0:
                break
        out += f"{head}CAST(count_if({rest[:end]} AS BIGINT)"
        rest = rest[end:]
    return out + rest


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = _bigint_counts(sql)
        return fn

    return register
