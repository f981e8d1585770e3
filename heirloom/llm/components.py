"""Connected components of a large graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirloom.llm.common import discard, settle


def _starred(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One large star (neighbours above a node move to its smallest neighbour) and one small star (those below), and what was settled on the way.

    Smallest neighbours are written before they are joined, so that both sides of the join are plain exchanges and
    Spark splits the rows of a hub.
    """
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    large = both.where("b > a").join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return small.select("e.a", "e.b").where("a <> b").distinct(), least


def _done(e: DataFrame) -> bool:
    """Whether every node points to one smaller node, and that to none: then all are roots or point to theirs."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Node and root (the smallest node reachable) of every node that ``edges`` (a, b) name; settled.

    Both ends are of one ordered type.  Edges may repeat or join a node to itself, null ends are ignored.
    Rounds grow with the logarithm of the longest chain; each is written to the shared folder.
    """
    given = settle(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes = given.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    e, used = given.where("a <> b"), [given]
    while not _done(e):
        star, between = _starred(e)
        e = settle(star, "edges")
        discard(between, *used[1:])
        used = [given, e]
    out = settle(nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")
    discard(*used)
    return out
