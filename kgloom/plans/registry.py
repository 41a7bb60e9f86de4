"""Queries of the core operators by name, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, folder) under a name."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


from kgloom.plans import evaluate, graph, kinds, linkers, names, ragged, ranking, resolution, streams, vocabulary  # noqa: E402, F401


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Which orders matter for a nation's parts: graph, one layer of messages, weighted ranker, best documents."""
    return ranking.flagship(spark, d)
