"""The query catalog: a Spark callable per operator and, where SQL can say it, an equivalent statement."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CTES: dict[str, str] = {}
_STATEMENTS: dict[str, tuple[str, dict[str, str]]] = {}


def cte(name: str, body: str) -> str:
    """Name a shared sub-query of the SQL twins."""
    CTES[name] = body
    return name


def compose(body: str, local: dict[str, str] | None = None) -> str:
    """Prefix a statement with the named sub-queries it uses, in dependency order."""
    known = {**CTES, **(local or {})}
    done: list[str] = []

    def visit(text: str, seen: tuple[str, ...]) -> None:
        for word in dict.fromkeys(re.findall(r"[A-Za-z_]\w*", text)):
            if word in known and word not in done and word not in seen:
                visit(known[word], (*seen, word))
                done.append(word)

    visit(body, ())
    if not done:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({known[n]})" for n in done) + "\n" + body


def query(name: str, sql: str | None = None, **local: str):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            _STATEMENTS[name] = (sql, local)
        return fn

    return register


def finish() -> None:
    """Compose the statements once every module has named its sub-queries."""
    for name, (sql, local) in _STATEMENTS.items():
        SQL.setdefault(name, compose(sql, local))
