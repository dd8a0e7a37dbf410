"""Registry of the runnable queries: a name, the operators it covers, the Spark plan, the oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pregame.session import prepare, spread

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Builder
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under ``name``; ``covers`` lists operator ids separated by spaces."""

    def wrap(build: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spread(prepare(spark), sf_dir)
            return build(spark, sf_dir)

        REGISTRY[name] = Query(name, tuple(covers.split()), run, sql)
        return build

    return wrap
