"""Registration of runnable queries: Spark plan, output columns, SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Values such as n/64 sit exactly between two 6-digit decimals; both engines scale by this
# factor before rounding so that such a tie falls the same way in each.
NUDGE = 1.000000000001

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    name: str
    plan: QueryFn
    columns: tuple[tuple[str, str], ...]
    sql: str | None
    covers: tuple[str, ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.plan(spark, sf_dir).select(*[_spark_out(n, k) for n, k in self.columns])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        outs = ", ".join(_sql_out(n, k) for n, k in self.columns)
        return f"SELECT {outs} FROM (\n{self.sql}\n) AS result_rows"


REGISTRY: dict[str, Registered] = {}


def _parse(out: str) -> tuple[tuple[str, str], ...]:
    pairs = []
    for token in out.split():
        name, _, kind = token.partition(":")
        pairs.append((name, kind or "f"))
    return tuple(pairs)


def _spark_out(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "s" or kind == "d":
        return c.cast("string").alias(name)
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "b":
        return c.cast("int").cast("bigint").alias(name)
    digits = int(kind[1:] or 6)
    return (F.round(c.cast("double") * F.lit(NUDGE), digits) + F.lit(0.0)).alias(name)


def _sql_out(name: str, kind: str) -> str:
    if kind == "s" or kind == "d":
        return f"CAST({name} AS VARCHAR) AS {name}"
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "b":
        return f"CAST(CAST({name} AS INTEGER) AS BIGINT) AS {name}"
    digits = int(kind[1:] or 6)
    return f"ROUND(CAST({name} AS DOUBLE) * CAST({NUDGE!r} AS DOUBLE), {digits}) + 0.0 AS {name}"


def query(out: str, *, covers: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``.

    ``out`` lists the output columns with kinds: ``s`` string, ``d`` date,
    ``i`` integer, ``b`` boolean, ``f`` double rounded to 6 digits (``f4``: 4).
    """

    def add(fn: QueryFn) -> QueryFn:
        if fn.__name__ in REGISTRY:
            raise ValueError(f"query {fn.__name__} registered twice")
        REGISTRY[fn.__name__] = Registered(
            fn.__name__, fn, _parse(out), sql, tuple(covers.replace(",", " ").split())
        )
        return fn

    return add
