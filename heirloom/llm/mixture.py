"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from heirloom.llm.common import order_key, ranked, without

#: Words of a text.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def text_mark(text: str) -> Column:
    """What tells texts apart: their md5; null counts as empty."""
    return F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))


def source_targets(sizes: DataFrame, weights: Sequence[float], share_num: int, share_den: int, most: int, least: int = 0) -> DataFrame:
    """Target size of each source: a row for each, so its one window task sees sources, never documents.

    Sources by code point, null last, weigh ``weights``, repeating.  They share ``share_num/share_den`` of
    all sizes by weight, none above ``most`` times its size; the excess goes to the others by weight until
    none is above.  That fixed point is found in one pass: with sources sorted by size over weight, a source
    is capped if the level, what those before it leave divided by the weights not yet served, would lift it
    above its cap.  Fractional weights are scaled to integers; a weight of 0 or less is an error.  With ``least`` above 0 every source first gets that many times its size and the rule
    deals out the rest.  Amounts stay integers up to one division.
    """
    by_name = W.Window.orderBy(F.col("source").isNull(), F.col("source"))
    whole = [Fraction(str(w)) for w in weights]
    if not whole or min(whole) <= 0:
        raise ValueError("weights must be positive")
    scale = math.lcm(*(w.denominator for w in whole))
    numbered = sizes.withColumn("number", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w * scale)) for w in whole]), (F.col("number") % len(whole) + 1).cast("int"))
    everything = W.Window.partitionBy(F.lit(0))
    t = numbered.select("source", "source_size", "number", weight.cast("long").alias("w"), ((most - least) * F.col("source_size")).alias("cap"))
    t = t.withColumn("all_w", F.sum("w").over(everything)).withColumn("num", share_num * F.sum("source_size").over(everything) - share_den * least * F.sum("source_size").over(everything))
    order = W.Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(W.Window.unboundedPreceding, -1)
    t = t.withColumn("num", F.col("num") - share_den * F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("left_w", F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0)))
    t = t.withColumn("capped", F.col("num") * F.col("w") > F.col("cap") * F.col("left_w") * share_den)
    free = F.when(~F.col("capped"), F.struct(F.col("num"), F.col("left_w")))
    t = t.withColumn("level", F.first(free, ignorenulls=True).over(order.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)))
    more = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("level.num") * F.col("w")).cast("double") / (F.col("level.left_w") * share_den).cast("double"))
    return t.select("source", "source_size", "number", (F.lit(least) * F.col("source_size") + more).alias("target"))


def time_of(done, slope):
    """The t in [0, 1] with t + a (t^2 - t) = done, for a slope a from -1 to 1."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * done)
    return F.when(slope == 0, done).otherwise((root - (1 - slope)) / (2 * slope))


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share_num: int = 3, share_den: int = 2, most: int = 2, least: int = 0,
    slopes: Sequence[float] = (0.5, 0.0, -0.5), seed: str = "mix", text: str | None = "text", key: str = "doc_id", mark: str | None = None,
) -> DataFrame:
    """Add size, source_size, target, taken, slope, done and position to every row.

    ``size`` is the number of words of ``text`` (None: a column of that name that is there already).  A source
    is read in a pseudo-random order, again and again, until its target is met: whole passes give every
    document that many times its size, and the last pass takes documents in order, the last one in part.  So
    ``taken`` sums to the target rounded down, and no document exceeds ``most`` times its size.

    Curriculum: the k-th source (by code point) is read at time t in [0, 1] at a rate in proportion to its target times 1 + a(2t - 1), with
    a from ``slopes``, repeating by k (above 0: later).  The integral t + a(t^2 - t) is the part of the
    source's words read by time t; ``done`` is that part before the document's first word in the first pass,
    and ``position`` the time at which it is reached.  Rows whose ``taken`` is 0 have a null position.

    Texts of any length count whole.  Null texts and empty ones have size 0 and are never taken.  Null sources form one source, last in order.
    Rows may repeat: each counts.  The order is that of a hash of key, size and the text's md5 (or of the column ``mark`` where ``text`` is None), so rows of one key, or of none, are spread over the
    source; rows equal in all three are interchangeable.  No row gives no row.  A column named like an added one is replaced.

    Prefix sums go through buckets, so a source with most of the rows is spread over many tasks.
    """
    new = ["size", "source_size", "target", "taken", "slope", "done", "position"]
    if text is None:
        sized = without(docs, new[1:])
    else:
        sized = without(docs, new).withColumn("size", word_count(text))
    kept = [F.col(f"`{c}`") for c in sized.columns]
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share_num, share_den, most, least)
    told = [text_mark(text)] if text is not None else [F.col(f"`{mark}`")] if mark else []
    keyed = sized.withColumn("__key", order_key(key, "size", *told, seed=seed))
    both = ranked(keyed, ["source"], "__key", ["size", key], "__rank", "size", "__before", sources)
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    rest = F.floor("target") - whole * F.col("source_size")
    taken = whole * F.col("size") + F.least(F.greatest(rest - F.col("__before"), F.lit(0)), F.col("size"))
    slope = F.element_at(F.array(*[F.lit(float(x)) for x in slopes]), (F.col("number") % len(slopes) + 1).cast("int"))
    out = both.select(*kept, "source_size", "target", taken.cast("long").alias("taken"), slope.alias("slope"), F.try_divide("__before", "target").alias("done"))
    return out.withColumn("position", F.when(F.col("taken") > 0, time_of(F.col("done"), F.col("slope"))))


def mixed_stream(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The documents in training order: each as often as passes of its source take words of it, range-partitioned
    and sorted by the position at which each pass reaches it.  Texts without words, of which nothing can be taken,
    appear ``least`` times, where the first pass reaches them.  The columns and their values are those of ``docs``, whatever their names."""
    least = options.get("least", 0)
    given = [F.col(f"`{c}`") for c in docs.columns]
    m = mix(docs.select(F.struct(*given).alias("given"), F.col(f"`{key}`").alias("key"), "source", word_count(text).alias("size"), text_mark(text).alias("mark")), text=None, key="key", mark="mark", **options)
    passes = F.when(F.col("size") == 0, F.lit(least)).otherwise(F.ceil(F.try_divide("taken", "size"))).cast("int")
    copies = m.withColumn("passes", passes).where("passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    done = F.least(F.coalesce(F.col("done") + F.try_divide(F.col("pass") * F.col("source_size"), F.col("target")), F.lit(0.0)), F.lit(1.0))
    out = copies.select("given", "key", time_of(done, F.col("slope")).alias("at"))
    return out.repartitionByRange("at", "key").sortWithinPartitions("at", "key").select("given.*")


def op4_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    sized = docs.withColumns({"size": word_count("text"), "mark": text_mark("text")}).drop("text")
    m = mix(sized, text=None, mark="mark").select("doc_id", "size", "source_size", "target", "taken", "position")
    return m.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix|' || coalesce(doc_id::VARCHAR, chr(0)) || '|' || len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) || '|' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 2 * source_size AS cap, (SELECT sum(size) FROM d) AS total FROM s),
o AS (SELECT *, 3 * total - 2 * coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
      sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w FROM w),
c AS (SELECT *, num * w > cap * left_w * 2 AS capped FROM o),
l AS (SELECT num AS l_num, left_w AS l_w FROM c WHERE NOT capped ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, number, CASE WHEN capped THEN cap::DOUBLE ELSE (l_num * w)::DOUBLE / (l_w * 2)::DOUBLE END AS target FROM c LEFT JOIN l ON true),
p AS (SELECT d.*, t.source_size, t.target, t.number, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN (floor(target / source_size) * size + least(greatest(floor(target) - floor(target / source_size) * source_size - ahead, 0), size))::BIGINT ELSE 0 END AS taken, [0.5, 0.0, -0.5][1 + number % 3]::DOUBLE AS a FROM p)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN CASE WHEN a = 0 THEN ahead / target ELSE (sqrt((1 - a) * (1 - a) + 4 * a * (ahead / target)) - (1 - a)) / (2 * a) END END AS position FROM q
"""
