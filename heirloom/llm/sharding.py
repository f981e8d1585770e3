"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

DataFrame functions draw, exchange and rank the rows; the driver draws only the matrix, which has a row
for each bucket (a fixed number) and a column for each shard.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from heirloom.llm.common import BUCKET_DIGITS, order_key, ranked, without


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """Exact draw: how many of ``drawn`` balls without replacement are good.

    Inversion that starts at the mode and alternates outwards, so that the steps grow with the standard
    deviation only.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma
    choose = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    p = math.exp(choose(good, mode) + choose(bad, drawn - mode) - choose(good + bad, drawn))
    u = rng.random() - p
    down = up = mode
    pd = pu = p
    while u > 0 and (down > low or up < high):
        if up < high:
            pu *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > low:
            pd *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
    return mode


def communication_matrix(counts: Sequence[int], shards: int, seed: str) -> list[list[int]]:
    """Rows of each bucket that go to each shard, as a uniformly random permutation would send them.

    Rows sum to ``counts``; columns to equal shares, the first ones one more if that leaves a rest.
    """
    rng = random.Random(seed)
    total = sum(counts)
    room = [total // shards + (k < total % shards) for k in range(shards)]
    matrix = []
    for n in counts:
        row, left, need = [], sum(room), n
        for k in range(shards):
            got = hypergeometric(rng, room[k], left - room[k], need)
            left -= room[k]
            need -= got
            row.append(got)
        room = [a - b for a, b in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def shard(docs: DataFrame, shards: int = 8, seed: str = "shard", key: str = "doc_id", text: str | None = "text") -> DataFrame:
    """Add size, text_crc32, law, shard, slot and grown_shard; every row goes to one slot of one shard.

    Law ``rows``: shards differ by one row at most.  Rows fall into 4096 buckets by the hash of ``key``, size and checksum, so that rows of one key, or of none, are spread; the
    drawn matrix says how many rows of each bucket go to each shard; a local permutation by a second hash
    decides which; after the exchange a third hash permutes each shard, and ranks are its slots, from 0
    without gaps.  Rows equal in key, size and checksum fall into one bucket and are interchangeable.  Texts may be of any length.  Null texts count as empty (size 1, checksum 0); a null key is a key like others.
    ``text`` None: size and text_crc32 are there already.  No row gives no row.  A column named like an
    added one is replaced.
    """
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    if text is None:
        base = without(docs, new[2:])
    else:
        raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
        base = without(docs, new).withColumns({"size": (F.octet_length(raw) + 1).cast("long"), "text_crc32": F.crc32(raw)})
    spark = docs.sparkSession
    told = (key, "size", "text_crc32")
    here = F.substring(order_key(*told, seed=f"{seed}-bucket"), 1, BUCKET_DIGITS)
    counts = {r["b"]: r["n"] for r in base.groupBy(here.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(counts)
    matrix = communication_matrix([counts[b] for b in names], shards, seed)
    ends = []
    for b, row in zip(names, matrix, strict=True):
        done, cut = 0, []
        for n in row:
            done += n
            cut.append(done)
        ends.append((b, cut))
    cuts = spark.createDataFrame(ends, "__b string, __ends array<bigint>")

    kept = [F.col(f"`{c}`") for c in base.columns]
    local = W.Window.partitionBy("__b").orderBy("__k1", key, "size", "text_crc32")
    drawn = base.withColumns({"__b": here, "__k1": order_key(*told, seed=f"{seed}-local"), "__k2": order_key(*told, seed=f"{seed}-slot")})
    sent = drawn.withColumn("__r", F.row_number().over(local) - 1).join(cuts, "__b")
    into = F.size(F.filter("__ends", lambda e: e <= F.col("__r")))
    exchanged = sent.select(*kept, "__k2", into.cast("int").alias("shard"))
    out = ranked(exchanged, ["shard"], "__k2", [key, "size", "text_crc32"], "slot")
    return out.select(*kept, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_hypergeometric_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
