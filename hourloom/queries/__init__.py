"""Runnable queries over the given tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hourloom.session import configure

Runner = Callable[[SparkSession, str], DataFrame]

RUNNERS: dict[str, Runner] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Runner], Runner]:
    """Register a query under its function name."""

    def register(run: Runner) -> Runner:
        def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(configure(spark), sf_dir)

        RUNNERS[run.__name__] = configured
        if sql is not None:
            SQL[run.__name__] = sql
        return configured

    return register


def load() -> None:
    """Import the query modules so that they register themselves."""
    from hourloom.queries import (  # noqa: F401
        evaluation,
        features,
        landing,
        profiles,
    )
    from hourloom.queries import models, reports  # noqa: F401, I001  the longest runs come last
