"""Named queries over the provided tables, each with the SQL that states its expected result."""

from __future__ import annotations

import functools
from collections.abc import Callable

from ..session import ship_package

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def add(fn):
        assert name not in QUERIES, name

        @functools.wraps(fn)
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def r(expr: str, digits: int) -> str:
    """SQL text of the library's half-up rounding."""
    return f"(floor(({expr}) * 1e{digits} + 0.5e0) / 1e{digits})"


def load_all() -> None:
    from . import calls, curation, evaluation, joined, ledger, long_clips, models, ordered, risk, signal, sources, streams  # noqa: F401
