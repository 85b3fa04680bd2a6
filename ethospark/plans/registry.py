"""Named queries over the given tables, each with a plain-SQL statement of the same answer."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ethospark.plans.oracle_views import SQL_VIEWS
from ethospark.plans.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use any view of ``oracle_views`` by name."""

    def add(build: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: build(Views(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return add


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the view definitions it (transitively) names."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    own = sql.strip()
    if not needed:
        return own
    parts = ",\n".join(f"{n} AS ({SQL_VIEWS[n].strip()})" for n in needed)
    for head in ("WITH RECURSIVE ", "WITH "):
        if own.upper().startswith(head):
            return f"{head}{parts},\n{own[len(head):]}"
    return f"WITH {parts}\n{own}"


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Round for comparison between engines; adding 0 turns -0.0 into 0.0."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), digits) + F.lit(0.0)
