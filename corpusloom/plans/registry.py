"""Registry filled by the query modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}

MODULES = (
    "corpus_queries", "line_queries", "vector_queries", "search_queries", "finding_queries", "code_queries",
    "log_queries", "review_queries", "stream_queries",
)


def query(name: str, ops: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` for the space-separated operator ids ``ops``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        OPERATORS[name] = tuple(ops.split())
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def load_all() -> None:
    for module in MODULES:
        try:
            import_module(f"corpusloom.plans.{module}")
        except ModuleNotFoundError as missing:
            if missing.name != f"corpusloom.plans.{module}":
                raise
