"""Every query by name, with its oracle SQL."""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import models, oracles, queries as _queries, states, stores

_MODULES = (_queries, states, stores, models)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries.ranking_metrics(spark, sf_dir)


def queries() -> dict:
    return {n: f for m in _MODULES for n, f in vars(m).items() if inspect.isfunction(f) and f.__module__ == m.__name__ and not n.startswith("_")}


def oracle_sql() -> dict[str, str]:
    found = dict(oracles.SQL)
    for m in _MODULES[1:]:
        found |= m.SQL
    return found
