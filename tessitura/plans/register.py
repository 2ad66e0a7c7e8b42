"""Registration of queries: SQL that both engines read, or a Spark function with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tessitura.plans import store

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, duck: str | None = None):
    """Register ``sql`` over the store's tables (``duck``: the oracle's own text), or decorate a function of the store."""

    def add(definition: Callable[[store.Store], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: definition(store.opened(spark, sf_dir))
        if text := duck or sql:
            ORACLES[name] = text
        return definition

    return add(lambda s: s.sql(sql)) if sql else add
