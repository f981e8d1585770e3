"""Merging new rows into a table that is rewritten as a whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], replace: Column | None = None) -> DataFrame:
    """Rows of ``old`` with those of ``new`` of the same keys in their place, and all others of both.

    ``replace`` (over the columns of alias ``old``) guards rows: where it is not true the old row stays.
    """
    a, b = old.withColumn("__old", F.lit(True)).alias("old"), new.withColumn("__new", F.lit(True)).alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    both = a.join(b, on, "full_outer")
    guard = F.lit(True) if replace is None else F.coalesce(replace, F.lit(False))
    take = F.col("new.__new").isNotNull() & (F.col("old.__old").isNull() | guard)
    return both.select(*[F.when(take, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in old.columns])


def keep_least(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row for each key, with the smallest value."""
    return rows.groupBy(*keys).agg(F.min(value).alias(value))
