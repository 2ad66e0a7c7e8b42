"""Every registered query of the engine's own operators, with its DuckDB oracle."""

from __future__ import annotations

from tessitura.operators import classify, embeddings, kernel, language_model, ngrams, relational, similarity, trends  # noqa: F401  (they register their queries)
from tessitura.plans import register, store


def queries():
    return dict(register.QUERIES)


def oracle_sql():
    return {name: store.oracle(sql) for name, sql in register.ORACLES.items()}
