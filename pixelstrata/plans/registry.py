"""Registered queries: name -> (Spark callable, equivalent SQL)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixelstrata.plans.views import SQL_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query over the given tables and, where possible, its SQL twin."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = expand(sql)
        return fn

    return add


def expand(sql: str) -> str:
    """Prepend the shared views a statement mentions and expand R<digits>(...)."""
    used: set[str] = set()

    def visit(text: str) -> None:
        for view in SQL_VIEWS:
            if view not in used and re.search(rf"\b{view}\b", text):
                used.add(view)
                visit(SQL_VIEWS[view])

    visit(sql)
    body = sql.strip()
    ctes = [f"{v} AS ({SQL_VIEWS[v]})" for v in SQL_VIEWS if v in used]
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    recursive = bool(head and head.group(1))
    if head:
        body = body[head.end():]
    if ctes:
        body = ", ".join(ctes) + (", " if head else " ") + body
    if ctes or head:
        body = ("WITH RECURSIVE " if recursive else "WITH ") + body
    return _expand_rounding(body)


def _expand_rounding(sql: str) -> str:
    """R6(x) -> round(x, 6) with the tie offset of ``rnd`` and without negative zero."""
    while (m := re.search(r"\bR(\d+)\(", sql)) is not None:
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        inner = sql[m.end(): i - 1]
        sql = (
            f"{sql[:m.start()]}(round(CAST(({inner}) AS DOUBLE) + CAST({3.7 * 10.0 ** (-int(m.group(1)) - 4)!r} AS DOUBLE), {m.group(1)})"
            f" + CAST(0 AS DOUBLE)){sql[i:]}")
    return sql
