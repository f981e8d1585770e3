"""The best rows of each group, and of all, without gathering a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def top_each(rows: DataFrame, group: Sequence[str], best: str, ties: Sequence[str], most: int, rank: str = "rank") -> DataFrame:
    """Add the rank, from 1, of each group's ``most`` rows with the largest ``best``, and keep only those.

    Equal values go by ``ties``, the smaller first; nulls in ``best`` come last.  A null group is a group like others.  Spark limits each group to ``most`` rows in every task before the exchange
    and again after it (its window group limit, for up to 1000 rows a group), so of a group that holds most of the rows each task sends ``most``.
    """
    order = W.Window.partitionBy(*group).orderBy(F.col(best).desc_nulls_last(), *ties)
    return rows.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= most)


def top_all(rows: DataFrame, best: str, ties: Sequence[str], most: int) -> DataFrame:
    """The ``most`` rows with the largest ``best`` in order; ties as in ``top_each``.  Each task keeps ``most`` rows."""
    return rows.orderBy(F.col(best).desc_nulls_last(), *ties).limit(most)
