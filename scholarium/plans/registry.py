"""Registry of named queries and the SQL each is compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scholarium.plans.views import VIEW_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the definitions of the views it mentions, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEW_SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ", ".join(f"{name} AS ({VIEW_SQL[name]})" for name in needed)
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    if head:
        keyword = "WITH RECURSIVE " if head.group(1) else "WITH "
        return f"{keyword}{ctes}, {sql[head.end():]}"
    return f"WITH {ctes} {sql}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its comparison SQL if there is one."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
