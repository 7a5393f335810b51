"""Registered queries: a Spark plan over the given tables and, where one exists, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan; ``sql`` gives the same rows and column names in ANSI SQL."""

    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, plan, sql.strip() if sql else None)
        return plan

    return register


def with_ctes(*parts: str) -> str:
    """``WITH`` of the CTEs given; the last part is the statement, maybe with CTEs before it."""
    *ctes, last = [p.strip() for p in parts]
    glue = "\n" if last.upper().startswith("SELECT") else ",\n"
    return "WITH " + ",\n".join(ctes) + glue + last
