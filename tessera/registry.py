"""Names every query of the library and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .sources.model import oracle, view

FLAGSHIP = "A03_graph_statistics"
PLANS = ("scalars", "relational", "writes", "graph", "retrieval", "resolution", "quality", "pipeline", "metrics", "streams", "answers", "composites")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Registers a function of the named tables and views under ``name``, with its DuckDB SQL if there is one."""

    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(view(spark, sf_dir, t) for t in tables))

        run.__name__ = name
        assert name not in _QUERIES, name
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = oracle(sql)
        return f

    return keep


def _load() -> None:
    for plan in PLANS:
        import_module(f"tessera.plans.{plan}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
