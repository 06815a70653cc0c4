"""Registry of runnable queries with the SQL they are checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import fixtures
from tidemark.sources.tables import Tables

MODULES = (
    "segments", "recipes", "extracts", "panels", "profiles", "experiments", "statistics",
    "rollups", "storage", "learning",
)


@dataclass(frozen=True)
class Query:
    name: str
    ids: str  # inventory rows the query covers
    build: Callable[[Tables], DataFrame]
    sql: str | None = None


_QUERIES: dict[str, Query] = {}
bodies: dict[str, str] = {}  # the SQL of queries as written, before the adapter views are put in front


def query(name: str, ids: str, sql: str | None = None):
    """Register a function of the logical tables; ``sql`` may use the adapter views."""

    def wrap(build: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        if sql is not None:
            bodies[name] = sql
        _QUERIES[name] = Query(name, ids, build, None if sql is None else fixtures.with_views(sql))
        return build

    return wrap


def load_all() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"tidemark.catalog.{module}")
    return dict(_QUERIES)


def portable(df: DataFrame) -> DataFrame:
    """Plain column types for comparing engines: exact decimals become doubles at
    the very end, dates become ISO text."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            out[f.name] = F.col(f.name).cast("double")
        elif isinstance(f.dataType, T.DateType):
            out[f.name] = F.date_format(f.name, "yyyy-MM-dd")
    return df.withColumns(out) if out else df


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(q.build(fixtures.load(spark, sf_dir)))

    run.__name__ = q.name
    return run
