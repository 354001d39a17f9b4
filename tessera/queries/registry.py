"""Registered queries, each with the SQL that must give the same rows.

SQL common table expressions are kept by name with what they build on; a query
lists only its last step.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TEXT_TABLES = ("documents", "pages", "conversations")      # costly row work: one split per core at least
_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    _CTES[name] = (needs, body)


def body(name: str) -> str:
    return _CTES[name][1]


def with_ctes(body: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n):
        for m in _CTES[n][0]:
            visit(m)
        if n not in order:
            order.append(n)
    for n in needs:
        visit(n)
    head = ",\n".join(f"{n} AS (\n{_CTES[n][1].strip()}\n)" for n in order)
    body = body.strip()
    start = "WITH RECURSIVE" if any(re.search(rf"\b{n}\b", _CTES[n][1]) for n in order) else "WITH"
    if head and body.startswith("WITH "):
        return f"{start} {head},\n{body[5:]}"
    return (f"{start} {head}\n" if head else "") + body


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_ctes(sql, *needs)
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, a file or a folder, as a stream of its files. Only a pattern may name a single file."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
