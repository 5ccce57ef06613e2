"""Query registry."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]
MODULES = (
    "text", "routing", "search", "retrieval", "answer", "graph", "ingest", "index", "golden", "evaluate", "memory", "state",
)


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


_FOUND: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its name, with the SQL that must give the same rows."""

    def register(run: Run) -> Run:
        if run.__name__ in _FOUND:
            raise ValueError(f"query {run.__name__} registered twice")
        _FOUND[run.__name__] = Query(run.__name__, run, sql)
        return run

    return register


def all_queries() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"quillspark.catalog.{module}")
    return dict(_FOUND)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
