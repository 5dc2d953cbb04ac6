"""Helpers for turning computed arrays into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def unfold(df: DataFrame, array, keep=(), item: str = "item", position: str | None = None) -> DataFrame:
    """Explode a computed array, evaluating it once.

    An inner explode makes the optimiser infer `size(array) > 0` below every projection, so the
    expression would be computed again (several times) in a pushed-down filter. The outer form
    has no such filter; rows of empty arrays are dropped afterwards by their missing position.
    """
    array = F.col(array) if isinstance(array, str) else array
    keep = [F.col(k) if isinstance(k, str) else k for k in keep]
    rows = df.select(*keep, F.posexplode_outer(array).alias("_position", item))
    rows = rows.filter(F.col("_position").isNotNull())
    return rows.withColumnRenamed("_position", position) if position else rows.drop("_position")


def unfold_structs(df: DataFrame, array, keep=()) -> DataFrame:
    """As `unfold`, with the struct's fields as columns."""
    rows = unfold(df, array, keep, item="_item")
    names = [c for c in rows.columns if c != "_item"]
    return rows.select(*names, "_item.*")


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on an expensive computed column without recomputing it.

    A plain filter would be pushed below the projections and repeat their expressions in its
    predicate; the outer explode in between keeps them evaluated once.
    """
    marked = df.select("*", F.posexplode_outer(
        F.when(condition, F.array(F.lit(True)))).alias("_position", "_kept"))
    return marked.filter(F.col("_position").isNotNull()).drop("_position", "_kept")
