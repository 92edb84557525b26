"""Registry of queries: name -> Spark callable, and the SQL it is checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .inputs import VIEWS

COMPUTED_ONCE = ("log0",)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Derived input ``name`` as a projection of its base table."""
    base, columns, where = VIEWS[name]
    df = view(spark, sf_dir, base) if base in VIEWS else table(spark, sf_dir, base)
    if where:
        df = df.where(where)
    df = df.selectExpr(*columns)
    # Columns of these views are used many times in the next one: computed once here, they are not copied there.
    return df.select(F.inline(F.array(F.struct(*df.columns)))) if name in COMPUTED_ONCE else df


def _view_sql(name: str, done: list[str]) -> None:
    if name in done:
        return
    base, columns, where = VIEWS[name]
    if base in VIEWS:
        _view_sql(base, done)
    done.append(name)


def with_views(names: tuple[str, ...], sql: str) -> str:
    """Prefix ``sql`` with the CTEs of the derived inputs it reads."""
    done: list[str] = []
    for name in names:
        _view_sql(name, done)
    if not done:
        return sql
    parts = []
    for name in done:
        base, columns, where = VIEWS[name]
        cond = f" WHERE {where}" if where else ""
        parts.append(f"{name} AS (SELECT {', '.join(columns)} FROM {base}{cond})")
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; ``sql`` may read the derived inputs in ``views``."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn

    return add
