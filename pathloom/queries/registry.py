"""The registered queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from ..shipping import ship
from . import algebra, patterns, pipeline, programs, tests_of_values

MODULES = (algebra, tests_of_values, patterns, pipeline, programs)


def _shipped(f: Callable) -> Callable:
    def query(spark, sf_dir: str):
        ship(spark)
        return f(spark, sf_dir)

    return query


def queries() -> dict:
    return {k: _shipped(f) for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
