"""The catalogue of runnable queries over the driver tables, each with its SQL twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its operator id; `sql` is the independent DuckDB statement."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def as_files(df: DataFrame, path: str | None = None, text: bool = False) -> str:
    """Write rows as JSON lines (or a text column as lines) in several files, for a reader to read; returns the folder."""
    path = path or f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stores/{uuid.uuid4().hex}"
    several = df.repartition(3)
    several.write.text(path) if text else several.write.json(path)
    return path
