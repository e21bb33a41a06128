"""Registered queries: each reads the driver tables and carries its DuckDB twin."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from eventide.session import tune

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


class Tables:
    """Attribute access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder
        self._read: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return os.path.join(self.folder, f"{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        # Reading a table infers its schema from a footer; once per query is enough.
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(self.path(name))
        return self._read[name]


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a query under its function name."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        REGISTRY[fn.__name__] = Query(fn.__name__, fn, sql)
        return fn

    return wrap


def load_all() -> dict[str, Query]:
    from eventide.plans import decisions, learning, market, news, states, streams, study  # noqa: F401

    return REGISTRY
