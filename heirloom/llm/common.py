"""Helpers that the corpus operators share.

Every helper keeps data distributed; only tables whose size is checked first reach the driver.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

#: Leading hex digits of an order key that make up its bucket: 4096 buckets a group.
BUCKET_DIGITS = 3

#: Bytes of text that the array code below looks at together.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  Where the cluster names none, a local one serves if the executors run in the driver, as in tests; else this is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='heirloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders of the ``scratch`` blocks that are open, the innermost last.
_open: list[str] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """All that is settled inside goes to one folder, which is removed at the end of the block.

    Operators return frames that read what they settled, so write the result inside the block.  Without a
    block it is the owner of the shared folder who clears it.
    """
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _open.append(path)
    try:
        yield path
    finally:
        _open.remove(path)
        remove(spark, path)


def place(spark: SparkSession, name: str) -> str:
    """A fresh path in the innermost open block, else in the shared folder."""
    return f"{_open[-1] if _open else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Of what is written inside, Spark deletes the shuffle files as soon as a write has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, outlives executors and frees its shuffle files."""
    path = place(df.sparkSession, name)
    with freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``settle``, bucketed by ``key``, so that joins on it need no exchange of these rows.

    Only a table can be bucketed; it leaves the catalog at once, while the frame keeps its files and buckets.  Without a width of its own it
    has as many buckets as a shuffle has partitions.
    """
    spark, table_name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    with freed(spark):
        df.write.bucketBy(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), key).option("path", place(spark, name)).saveAsTable(table_name)
    out = spark.table(table_name)
    spark.sql(f"DROP TABLE {table_name}")
    return out


def discard(*settled: DataFrame) -> None:
    """Delete the folders of settled frames that nothing will read again."""
    for df in settled:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            remove(df.sparkSession, path)


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` less the columns whose names (in any case) an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``df`` has (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns named by their place, which no operator's columns clash with, and the new name of each."""
    names = [f"__{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def order_key(*cols: Column | str, seed: str) -> Column:
    """A pseudo-random, reproducible hex string; the same rows get the same key on every run."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\x00")) for c in cols]
    return F.md5(F.concat_ws("|", F.lit(seed), *parts))


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Join condition on ``keys`` under which null equals null."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def ranked(df: DataFrame, group: Sequence[str], key: str, ties: Sequence[str], rank: str, size: str | None = None, before: str | None = None, attach: DataFrame | None = None) -> DataFrame:
    """Add the 0-based rank within ``group`` by hex ``key`` and, if asked, the sum of ``size`` before each row.

    A group may hold most of the rows, so none is ever sorted in one task: the first hex digits of
    the key cut it into buckets, buckets are counted with map-side partial sums, and each row adds
    its place in its bucket to the rows in the buckets before.  ``ties`` order equal keys.  Columns of ``attach``, a row for
    each group, come along with the bucket sums.  One text names group and bucket, so that ranking and joining
    share one exchange of the rows.
    """
    group = list(group)
    name = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in group]
    cut = df.withColumn("__cell", F.concat_ws("\x00", *name, F.substring(key, 1, BUCKET_DIGITS)))
    sums = [F.count(F.lit(1)).alias("__n")] + ([F.sum(size).alias("__s")] if size else [])
    counts = cut.groupBy(*group, "__cell").agg(*sums)
    ahead = W.Window.partitionBy(*group or [F.lit(0)]).orderBy("__cell").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = counts.select(
        *group, "__cell", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__n0"),
        *([F.coalesce(F.sum("__s").over(ahead), F.lit(0)).alias("__s0")] if size else []),
    )
    more = [] if attach is None else [c for c in attach.columns if c not in group]
    if attach is not None:
        starts = starts.alias("s").join(attach.alias("t"), same_keys("s", "t", group), "left").select(*[F.col(f"s.`{c}`") for c in starts.columns], *[F.col(f"t.`{c}`") for c in more])
    near = W.Window.partitionBy("__cell").orderBy(key, *ties)
    out = cut.withColumn("__r", F.row_number().over(near) - 1)
    if size:
        out = out.withColumn("__b", F.coalesce(F.sum(size).over(near.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))
    joined = out.alias("a").join(starts.alias("b"), F.col("a.__cell") == F.col("b.__cell"))
    return joined.select(
        *[F.col(f"a.`{c}`") for c in df.columns], *[F.col(f"b.`{c}`") for c in more], (F.col("__n0") + F.col("__r")).cast("long").alias(rank),
        *([(F.col("__s0") + F.col("__b")).cast("long").alias(before)] if size else []),
    )


def crc_text(col: str) -> Column:
    """crc32 of a value written as text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def appended(schema: T.StructType, fields: Sequence[T.StructField]) -> T.StructType:
    return T.StructType([*schema.fields, *fields])


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty texts, and its offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of the batches with at most ``limit`` bytes of text (or one row), their bytes and offsets."""
    for batch in batches:
        data, offsets = utf8(batch.column(column))
        start, rows = 0, batch.num_rows
        while start < rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            end = min(end, rows)
            yield batch.slice(start, end - start), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
            start = end


def with_columns(batch: pa.RecordBatch, **new: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *new.values()], names=[*batch.schema.names, *new])


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        _powers[base] = np.cumprod(x)
    return _powers[base][:n]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit polynomial hash of each span of byte codes; equal spans have equal hashes wherever they stand."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(table[codes] * powers(_BASE, len(codes)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(_UNBASE, len(codes) + 1)[starts] + (ends - starts).astype(np.uint64))


def _word_codes() -> np.ndarray:
    """Of each byte: 0 outside words, else itself with A-Z lower-cased; words hold 0-9, a-z and all beyond ASCII."""
    code = np.zeros(256, np.uint8)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        code[b] = b
    code[0x41:0x5B] = np.arange(0x61, 0x7B)
    return code


WORD_CODES = _word_codes()


def word_spans(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray = WORD_CODES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a run of texts, byte start and end of every word, and the index of each text's first word."""
    low = codes[data]
    inside = low != 0
    first, last = inside.copy(), inside.copy()
    if len(low):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(low))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray = WORD_CODES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and byte start of every word of a run of texts, and the index of each text's first word."""
    low, starts, ends, bounds = word_spans(data, offsets, codes)
    return span_hashes(low, starts, ends), starts, bounds


def gram_hashes(hashes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of k consecutive word hashes; the caller masks runs that cross texts."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, seed * 0x2545F4914F6CDD1D % (1 << 64), np.uint64)
    for j in range(k):
        out *= np.uint64(0x5851F42D4C957F2D)
        out += hashes[j : j + n]
    return mixed(out)


def run_starts(bounds: np.ndarray, k: int, total: int) -> np.ndarray:
    """Mask over 0..total-k of the runs of k words that stay within one text."""
    n = max(0, total - k + 1)
    ok = np.ones(n, bool)
    for d in range(1, k):
        cut = bounds[1:-1] - d
        ok[cut[(cut >= 0) & (cut < n)]] = False
    return ok
