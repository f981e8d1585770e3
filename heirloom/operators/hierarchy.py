"""Trees of lines: parents from levels, and what hangs below a line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from heirloom.functions.text import filled, trimmed
from heirloom.sources.store import settle


#: Line numbers in one bucket.
WIDTH = 1 << 17


def with_records(lines: DataFrame, key: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    """Add record_no, the number of level-0 lines so far in the file, and record_xref, the xref of the last one (or empty).

    A file is never sorted in one task: buckets of ``width`` line numbers are counted first, and a line adds the level-0 lines of the
    buckets before to those before it in its own.
    """
    key = list(key)
    head = F.when(F.col("level") == 0, F.struct(F.coalesce("xref", F.lit("")).alias("x")))
    cut = lines.withColumns({"__b": F.floor(F.col("line_no") / width), "__h": head})
    before = W.Window.partitionBy(*key or [F.lit(0)]).orderBy("__b").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = cut.groupBy(*key, "__b").agg(F.count("__h").alias("__n"), F.max_by("__h", F.when(F.col("level") == 0, F.col("line_no"))).alias("__x"))
    starts = sums.select(*key, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.last("__x", ignorenulls=True).over(before).alias("__x0"))
    near = W.Window.partitionBy(*key, "__b").orderBy("line_no").rowsBetween(W.Window.unboundedPreceding, 0)
    inside = cut.withColumns({"__r": F.count("__h").over(near), "__l": F.last("__h", ignorenulls=True).over(near)})
    out = inside.join(starts, [*key, "__b"])
    return out.select(*[F.col(f"`{c}`") for c in lines.columns], (F.col("__n0") + F.col("__r")).alias("record_no"), F.coalesce(F.coalesce("__l", "__x0")["x"], F.lit("")).alias("record_xref"))


def with_parents(lines: DataFrame, record: Sequence[str] = ("record_no",)) -> DataFrame:
    """Add parent_line: of a line of level L the last line before it in its record with a level below L, if that is L - 1; else null.

    Levels that occur are few, so one window pass keeps the last line of at most each level; records are
    the partitions.
    """
    levels = sorted(r[0] for r in lines.select("level").distinct().collect() if r[0] is not None)
    w = W.Window.partitionBy(*record).orderBy("line_no").rowsBetween(W.Window.unboundedPreceding, -1)
    parent = F.lit(None).cast("long")
    for level in levels:
        if level > 0 and level - 1 in levels:
            last = F.last(F.when(F.col("level") < level, F.struct("line_no", "level")), ignorenulls=True).over(w)
            parent = F.when(F.col("level") == level, F.when(last["level"] == level - 1, last["line_no"])).otherwise(parent)
    return lines.withColumn("parent_line", parent)


def with_tree(lines: DataFrame, width: int = WIDTH) -> DataFrame:
    """Add record_no, record_xref, parent_line and parent_tag to the lines of one file, in one exchange: what ``with_records`` and ``with_parents`` give, and the tag of the parent.

    A line's parent needs no records: the last line before it with a level below its own is never ahead of the record's level-0 line.  Of each bucket of ``width`` line
    numbers the last line of each level is looked up first, and what earlier buckets leave is carried over in a row for each bucket.  ``lines`` is read three times, so give what was written.
    """
    cut = lines.withColumn("__b", F.floor(F.col("line_no") / width))
    ends = cut.groupBy("__b", "level").agg(F.max("line_no").alias("line_no"), F.count(F.lit(1)).alias("__n"))
    ends = settle(settle(ends, "ends").join(lines.select("line_no", "xref", "tag"), "line_no"), "tops")
    levels = sorted(r[0] for r in ends.select("level").distinct().collect() if r[0] is not None)
    over = [level for level in levels if level > 0 and level - 1 in levels]
    head = F.when(F.col("level") == 0, F.struct(F.coalesce("xref", F.lit("")).alias("x")))
    above = lambda level: F.when(F.col("level") < level, F.struct("line_no", "level", "tag"))
    last = lambda value: F.max_by(value, F.when(value.isNotNull(), F.col("line_no")))
    sums = ends.groupBy("__b").agg(F.sum(F.when(F.col("level") == 0, F.col("__n")).otherwise(0)).alias("__n"), last(head).alias("__x"), *[last(above(n)).alias(f"__p{n}") for n in over])
    before = W.Window.orderBy("__b").rowsBetween(W.Window.unboundedPreceding, -1)  # a row for each bucket
    kept = lambda c: F.last(c, ignorenulls=True).over(before)
    starts = sums.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), kept("__x").alias("__x0"), *[kept(f"__p{n}").alias(f"__c{n}") for n in over])
    near = W.Window.partitionBy("__b").orderBy("line_no")
    upto, ahead = near.rowsBetween(W.Window.unboundedPreceding, 0), near.rowsBetween(W.Window.unboundedPreceding, -1)
    parent = F.when(F.lit(False), F.struct("line_no", "level", "tag"))
    for n in over:
        parent = parent.when(F.col("level") == n, F.coalesce(F.last(above(n), ignorenulls=True).over(ahead), F.col(f"__c{n}")))
    out = cut.join(starts, "__b").withColumns({"__r": F.count(head).over(upto), "__l": F.last(head, ignorenulls=True).over(upto), "__p": parent})
    of = lambda field: F.when(F.col("__p.level") == F.col("level") - 1, F.col(f"__p.{field}"))
    return out.select(
        *[F.col(f"`{c}`") for c in lines.columns], (F.col("__n0") + F.col("__r")).alias("record_no"), F.coalesce(F.coalesce("__l", "__x0")["x"], F.lit("")).alias("record_xref"),
        of("line_no").alias("parent_line"), of("tag").alias("parent_tag"),
    )


def assembled(lines: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Add full: the value with what CONC lines below append and CONT lines append after a line end, in order."""
    more = lines.where(F.col("tag").isin("CONC", "CONT") & F.col("parent_line").isNotNull())
    piece = F.struct("line_no", F.when(F.col("tag") == "CONT", F.concat(F.lit("\n"), "value")).otherwise(F.col("value")).alias("v"))
    joined = more.groupBy(*key, F.col("parent_line").alias("line_no")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["v"]), "").alias("__more"))
    return lines.join(joined, [*key, "line_no"], "left").withColumn("full", F.concat("value", F.coalesce("__more", F.lit("")))).drop("__more")


def first_child(tag: str, value: Column) -> Column:
    """Aggregate over the children of a line: of those with ``tag`` the first one's value in a struct v; null if there is none."""
    return F.min(F.when(F.col("tag") == tag, F.struct("line_no", value.alias("v"))))["v"]


def clean(value: Column) -> Column:
    """Trimmed, or null if nothing is left."""
    return filled(trimmed(value))
