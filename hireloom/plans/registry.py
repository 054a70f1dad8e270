"""Named queries with their DataFrame plan and, where SQL can say it, their reference SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from hireloom.sources.views import CTES, Views


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Views], DataFrame]
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a plan: a function of the relations that returns a DataFrame."""

    def add(plan: Callable[[Views], DataFrame]):
        CATALOGUE[name] = Query(name, plan, sql)
        return plan

    return add


def with_relations(sql: str) -> str:
    """Put the definitions of the derived relations that `sql` names in front of it."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in CTES[name][0]:
            add(other)
        if name not in needed:
            needed.append(name)

    for name in CTES:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in needed)
    body = sql.strip()
    recursive = body[:14].upper() == "WITH RECURSIVE"
    if recursive or body[:5].upper() == "WITH ":
        head, rest = ("WITH RECURSIVE ", body[14:]) if recursive else ("WITH ", body[5:])
        return f"{head}{ctes},\n{rest.strip()}"
    return f"WITH {ctes}\n{body}"


def load() -> dict[str, Query]:
    from hireloom.plans import access, documents, graphs, matches, profiles, relational, retrievals, streams, taxonomies, vectors  # noqa: F401

    if "match_run" not in CATALOGUE:
        matches._register_runs()
    return CATALOGUE


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, q=q: q.plan(Views(spark, sf_dir))) for name, q in load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_relations(q.sql) for name, q in load().items() if q.sql}
