"""The query registry: one Spark plan per name and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidewire.plans.standins import Inputs


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    plan: Callable[[Inputs], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.plan(Inputs(spark, sf_dir))


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None, name: str | None = None):
    """Register a plan under its function name. ``covers`` lists blueprint rows."""
    def wrap(plan: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        key = name or plan.__name__
        if key in REGISTRY:
            raise ValueError(f"duplicate query: {key}")
        REGISTRY[key] = Query(key, tuple(covers.split()), plan, sql)
        return plan
    return wrap
