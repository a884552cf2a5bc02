"""Query registry: one entry per operator, with its output contract and oracle.

``out`` lists the output columns as ``name:kind`` with kind ``i`` (BIGINT),
``f`` (DOUBLE, six decimals) or ``s`` (STRING).  The same contract is applied
to the Spark result and to the oracle SQL, so both sides agree on names, types
and rounding.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import measured_joins, prepare

# Shift that keeps decimal ties away from the rounding edge in both engines.
NUDGE = 1e-10


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    out: tuple[tuple[str, str], ...]
    body: str | None
    needs: str

    @property
    def sql(self) -> str | None:
        """Complete oracle query, or None for operators SQL cannot express."""
        return contract_sql(with_ctes(self.needs, self.body), self.out) if self.body else None


REGISTRY: dict[str, Query] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def contract(df: DataFrame, out: tuple[tuple[str, str], ...]) -> DataFrame:
    def shaped(name: str, kind: str):
        if kind == "i":
            return F.col(name).cast("bigint").alias(name)
        if kind == "f":
            return (F.round(F.col(name).cast("double") + F.lit(NUDGE), 6) + F.lit(0.0)).alias(name)
        return F.col(name).cast("string").alias(name)

    return df.select(*[shaped(name, kind) for name, kind in out])


def contract_sql(sql: str, out: tuple[tuple[str, str], ...]) -> str:
    def shaped(name: str, kind: str) -> str:
        if kind == "i":
            return f'CAST({name} AS BIGINT) AS {name}'
        if kind == "f":
            return f'ROUND(CAST({name} AS DOUBLE) + {NUDGE}, 6) + 0.0 AS {name}'
        return f'CAST({name} AS VARCHAR) AS {name}'

    body = ", ".join(shaped(name, kind) for name, kind in out)
    return f"SELECT {body} FROM ({sql}) AS answer"


def cte(name: str, sql: str, needs: str = "") -> None:
    """Register a named building block of the oracle queries."""
    CTES[name] = (tuple(needs.split()), sql)


def with_ctes(needs: str, sql: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for parent in CTES[name][0]:
            visit(parent)
        order.append(name)

    for name in needs.split():
        visit(name)
    if not order:
        return sql
    looping = {n for n in order if "RECURSIVE" in CTES[n][1]}
    recursive = "RECURSIVE " if looping else ""
    # Building blocks are computed once, not once per mention or round.
    kept = " MATERIALIZED"
    head = ", ".join(f"{n} AS{'' if n in looping else kept} ({CTES[n][1]})" for n in order)
    return f"WITH {recursive}{head} {sql}"


def query(name: str, out: str, sql: str | None = None, needs: str = ""):
    """Register ``fn(spark, root)`` under ``name``."""
    columns = tuple(tuple(part.split(":")) for part in out.split())

    def wrap(fn):
        def run(spark: SparkSession, root: str) -> DataFrame:
            return contract(fn(measured_joins(prepare(spark)), root), columns)

        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, run, columns, sql, needs)
        return fn

    return wrap
