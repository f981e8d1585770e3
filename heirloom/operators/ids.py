"""Dense ids in a given order without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from heirloom.sources.store import settle

#: Values of the ordering column in one bucket.
WIDTH = 1 << 17


def dense_ids(df: DataFrame, order: str, name: str = "id", width: int = WIDTH, ties: Sequence[str] = ()) -> DataFrame:
    """Add ids 1, 2, 3, ... in the order of the integers in ``order``, equal ones by ``ties``.

    Buckets of ``width`` values are counted first; a row's id is the rows in buckets before its own plus its place there.
    """
    cut = df.withColumn("__b", F.floor(F.col(order) / width))
    counts = cut.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = W.Window.orderBy("__b").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = counts.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    ranked = cut.withColumn("__r", F.row_number().over(W.Window.partitionBy("__b").orderBy(order, *ties)))
    return ranked.join(starts, "__b").withColumn(name, (F.col("__s") + F.col("__r")).cast("long")).drop("__b", "__s", "__r")


def sorted_ids(df: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """Add ids 1, 2, 3, ... in the order of columns of any type, whose values are distinct.

    Rows are range-partitioned, sorted and written with their place in their partition; partitions are counted, and a row's id is its place there
    plus the rows of the partitions before.  Ids don't depend on where the ranges are cut.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__n", F.monotonically_increasing_id())
    rows = settle(placed, "sorted").withColumn("__p", F.shiftright("__n", 33))
    before = W.Window.orderBy("__p").rowsBetween(W.Window.unboundedPreceding, -1)  # a row for each partition
    starts = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"), F.min("__n").alias("__n0")).select("__p", "__n0", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__s"))
    return rows.join(starts, "__p").withColumn(name, (F.col("__s") + F.col("__n") - F.col("__n0") + 1).cast("long")).drop("__p", "__n", "__n0", "__s")
