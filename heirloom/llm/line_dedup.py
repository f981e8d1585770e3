"""Lines that many documents repeat, found with two Bloom filters and confirmed by their text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirloom.llm.common import chunks, mixed, settle, span_hashes

#: Bits of a filter and of a page of it (powers of two), and bits that a key sets.
FILTER_BITS, PAGE_BITS, KEY_BITS = 27, 15, 3

#: Code points from which a key counts, and documents from which it is repeated.
LEAST_CHARS, LEAST_DOCS = 40, 5


def _lower() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[0x41:0x5B] += 0x20
    return out


#: A key in more rows than one of so many shares of all (and than so many) is dealt to several tasks; there can be no more such keys than shares.
SHARES, SHARE_ROWS = 1000, 256

LOWER = _lower()
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class Lines:
    """Lines of a run of texts: bounds (each text's first line), n, and of the keys that are long enough text, line and byte span."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int):
        ends_at = np.flatnonzero(data == 10)
        texts = len(offsets) - 1
        held = np.bincount(np.searchsorted(offsets, ends_at, "right") - 1, minlength=texts)[:texts]
        self.bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(held + 1)])
        total = int(self.bounds[-1])
        starts, ends = np.empty(total, np.int64), np.empty(total, np.int64)
        first, last = np.zeros(total, bool), np.zeros(total, bool)
        first[self.bounds[:-1]] = True
        last[self.bounds[1:] - 1] = True
        starts[first], starts[~first] = offsets[:-1], ends_at + 1
        ends[last], ends[~last] = offsets[1:], ends_at
        solid = np.flatnonzero(~SPACE[data])
        a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        some = a < b
        points = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])
        at = np.flatnonzero(some)
        lo, hi = solid[a[some]], solid[b[some] - 1] + 1
        long = points[hi] - points[lo] >= least
        self.line, self.lo, self.hi = at[long], lo[long], hi[long]
        self.text = np.searchsorted(self.bounds, self.line, "right") - 1
        self.low = LOWER[data]
        self.hashes = span_hashes(self.low, self.lo, self.hi)


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The KEY_BITS places in a filter of each hash."""
    step = mixed(hashes + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) >> np.uint64(64 - bits) for i in range(KEY_BITS)], axis=1)


def put(table: np.ndarray, at: np.ndarray) -> None:
    """Set the bits of a filter, kept as bytes, at places."""
    for b in range(8):
        where = (at[(at & np.uint64(7)) == b] >> np.uint64(3)).astype(np.int64)
        table[where] |= np.uint8(1 << b)


def holds(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row of places whether all are set."""
    return ((table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)


PAGES = "page int, once binary, twice binary"


def _filters(least: int, bits: int):
    """The two filters of a task's documents, as pages of the places that are set: a key found again goes to the second one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << (bits - 3), np.uint8)
        for _, data, offsets in chunks(batches, "t"):
            lines = Lines(data, offsets, least)
            order = np.lexsort((lines.hashes, lines.text))
            h, t = lines.hashes[order], lines.text[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
            keys, n = np.unique(h[new], return_counts=True)
            if len(keys):
                at = places(keys, bits)
                again = holds(once, at) | (n > 1)
                put(twice, at[again].ravel())
                put(once, at.ravel())
        width = 1 << (PAGE_BITS - 3)
        used = np.flatnonzero(once.reshape(-1, width).any(1))
        marks = lambda table, p: np.flatnonzero(np.unpackbits(table[p * width : (p + 1) * width], bitorder="little")).astype(np.uint16).tobytes()
        for some in np.array_split(used, max(1, len(used) // 512)):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([marks(once, p) for p in some], pa.binary()), pa.array([marks(twice, p) for p in some], pa.binary())], names=["page", "once", "twice"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second filters of pages, over all tasks: a bit that two tasks set once is set twice.  A page is held as one table, however many tasks sent it."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for page, once, twice in zip(*(batch.column(c).to_pylist() for c in ("page", "once", "twice")), strict=True):
            a, b = held.setdefault(page, (np.zeros(1 << PAGE_BITS, bool), np.zeros(1 << PAGE_BITS, bool)))
            at = np.frombuffer(once, np.uint16)
            b[at] |= a[at]
            b[np.frombuffer(twice, np.uint16)] = True
            a[at] = True
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(b, bitorder="little").tobytes() for _, b in held.values()], pa.binary())], names=["page", "twice"])


def twice_seen(texts: DataFrame, least: int = LEAST_CHARS, bits: int = FILTER_BITS) -> np.ndarray:
    """The second filter of the keys of ``texts`` (t): 2 ** bits bits, the only thing that reaches the driver."""
    pages = texts.mapInArrow(_filters(least, bits), PAGES).repartition("page").mapInArrow(_merged, "page int, twice binary")
    out = np.zeros((1 << (bits - PAGE_BITS), 1 << (PAGE_BITS - 3)), np.uint8)
    for page, twice in zip(*pages.toArrow().to_pydict().values(), strict=True):
        out[page] = np.frombuffer(twice, np.uint8)
    return out.ravel()


SCANNED = "n_lines long, digest string, keys array<struct<key: string, lines: array<int>>>, t string"


def _suspects(shared: Broadcast, least: int, bits: int):
    """Of each document the number of lines, the sha256 and the suspected keys with their lines; the text only if there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "t"):
            lines = Lines(data, offsets, least)
            keep = np.flatnonzero(holds(shared.value, places(lines.hashes, bits))) if len(lines.hashes) else []
            found: list[dict[str, list[int]]] = [{} for _ in range(batch.num_rows)]
            for i in keep:
                d = lines.text[i]
                key = lines.low[lines.lo[i] : lines.hi[i]].tobytes().decode()
                found[d].setdefault(key, []).append(int(lines.line[i] - lines.bounds[d]))
            texts = batch.column("t").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k"), pa.array(np.diff(lines.bounds), pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                    pa.array([[{"key": k, "lines": v} for k, v in f.items()] for f in found], pa.list_(pa.struct([("key", pa.string()), ("lines", pa.list_(pa.int32()))]))),
                    pa.array([t if f else None for t, f in zip(texts, found, strict=True)], pa.string()),
                ],
                names=["k", "n_lines", "digest", "keys", "t"],
            )

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text without its dropped lines and its sha256."""
    for batch in batches:
        texts, sums = [], []
        for t, drop, digest in zip(*(batch.column(c).to_pylist() for c in ("t", "dropped", "digest")), strict=True):
            if drop:
                gone = set(drop)
                t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
                digest = hashlib.sha256(t.encode()).hexdigest()
            texts.append(t if drop else None)
            sums.append(digest)
        columns = {"k": batch.column("k"), "n_lines": batch.column("n_lines"), "dropped": batch.column("dropped"), "kept": pa.array(texts, pa.string()), "kept_sha256": pa.array(sums, pa.string())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, bits: int = FILTER_BITS) -> DataFrame:
    """A row for each row of ``docs``: its key, n_lines, dropped (line numbers from 0), kept (its text without them; null if nothing is dropped) and kept_sha256.

    Lines end at a line feed; a null or empty text is one empty line.  A line's key is the line without white space (blank, tab, LF, VT, FF, CR) at both
    ends and with A-Z lower-cased.  A key of at least ``least_chars`` code points that at least ``least_docs`` rows hold loses all its lines except in rows of the
    largest ``key`` that holds it (all of them, if rows share it); a null key is the smallest.  Repeated rows count as documents of their own.  Lines and
    texts may be of any length; an empty table gives no row.  Other columns are not looked at, so their names don't matter.

    A first scan fills two Bloom filters, for hashes seen in one document and in two; pages of them are merged over tasks, and the second one, of fixed
    size, is broadcast.  A second scan lets only lines pass that it suspects.  Their keys are counted by their text, with partial counts before the
    shuffle, so a hash never decides; a line that it suspects wrongly is found once and stays.  A full filter suspects more lines, which
    costs shuffle and changes no row.  Documents without suspects never move their text.  Rows of a frequent key are dealt to several tasks, by a table of
    at most SHARES hashes, where they meet the verdict on it.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    kind = given.schema["k"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(twice_seen(given.select("t"), least_chars, bits))
    scanned = settle(given.mapInArrow(_suspects(shared, least_chars, bits), f"k {kind}, {SCANNED}").withColumn("row", F.monotonically_increasing_id()), "lines")
    suspects = scanned.select("row", "k", F.explode("keys").alias("s")).select("row", "k", "s.key", "s.lines")
    repeated = settle(suspects.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("last")).where(F.col("n") >= least_docs), "repeated")
    share = max(SHARE_ROWS, (repeated.agg(F.sum("n")).first()[0] or 0) // SHARES)
    hot = F.broadcast(repeated.where(F.col("n") > share).groupBy(F.xxhash64("key").alias("hash")).agg(F.max(F.ceil(F.col("n") / share)).cast("int").alias("parts")))
    dealt = lambda df: df.withColumn("hash", F.xxhash64("key")).join(hot, "hash", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).drop("hash")
    left = dealt(suspects).withColumn("part", F.pmod("row", "parts")).drop("parts")
    right = dealt(repeated).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).select("key", "last", "part")
    hits = left.join(right, ["key", "part"]).where(~F.col("k").eqNullSafe(F.col("last"))).groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("lines"))).alias("dropped"))
    both = scanned.drop("keys").join(hits, "row", "left").select("k", "n_lines", "digest", "t", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    return both.mapInArrow(_kept, f"k {kind}, n_lines long, dropped array<int>, kept string, kept_sha256 string").withColumnRenamed("k", key)


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "kept_sha256")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM (SELECT DISTINCT rid, doc_id, key FROM k WHERE length(key) >= 40) GROUP BY key HAVING count(*) >= 5),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.last AS gone FROM k LEFT JOIN r ON r.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY rid
"""
