"""Query registry: a name, the Spark form, and the SQL twin where one exists."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabloom.session import prepare
from tabloom.spec import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = (
    "sources", "scalars", "joins", "aggregates", "windows", "sampling", "sets",
    "series", "metrics", "stats", "insight", "text", "streams", "udfs",
)


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register ``fn(T)``, where ``T`` gives the tables; float results are rounded to ``digits``."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from tabloom.plans.fixtures import Tables

            return rounded(fn(Tables(prepare(spark), sf_dir)), digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"tabloom.plans.{m}")
