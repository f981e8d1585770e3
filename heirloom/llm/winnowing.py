"""Benchmark decontamination by winnowing.

Of every run of ``span`` words the smallest hash among its runs of ``k`` words is a fingerprint, in documents
and in benchmark items alike; a span that both share therefore shares a fingerprint.  Fingerprints that meet are
extended to the spans around them, words are compared there, and a document word inside any shared span is hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heirloom.llm.common import CHUNK_BYTES, appended, chunks, gram_hashes, run_starts, settle, span_hashes, unused, utf8, with_columns, without, word_spans

#: Words of a shared span, and of the runs that are hashed.
SPAN, K = 10, 5

#: Bytes of benchmark text whose index is broadcast; with more, fingerprints are joined.
BLOCK_BYTES = 8 << 20

#: What an item takes beside its text and id.
ITEM_BYTES = 64

#: Bits, as a power of two, of the table that holds the benchmark's fingerprints when they are joined: 16 MB.
FILTER_BITS = 27

#: Words of Spark's regular expressions; those of the array code hold the same bytes.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def least_grams(hashes: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every run of ``span`` words the smallest hash of its k-grams and where in the run it is, the last of equals."""
    grams = gram_hashes(hashes, k)
    width = span - k + 1
    n = max(0, len(grams) - width + 1)
    best, where = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, width):
        here = grams[j : j + n]
        less = here <= best
        best[less] = here[less]
        where[less] = j
    return best, where


def fingerprints(hashes: np.ndarray, bounds: np.ndarray, span: int = SPAN, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed k-grams: of every span within a text the smallest, the last one of equals."""
    best, where = least_grams(hashes, span, k)
    ok = np.flatnonzero(run_starts(bounds, span, len(hashes)))
    at, first = np.unique(ok + where[ok], return_index=True)
    return at, best[ok][first]


class Words:
    """The words of a run of texts: codes of all bytes, start and end of every word, their hashes, and each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.codes, self.starts, self.ends, self.bounds = word_spans(data, offsets)
        self.hashes = span_hashes(self.codes, self.starts, self.ends)


def _bytes_of(text: Words, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Codes of the words ``at``, one after the other."""
    step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return text.codes[np.repeat(text.starts[at], lengths) + step]


def same_runs(a: Words, at: np.ndarray, b: Words, to: np.ndarray, n: int) -> np.ndarray:
    """Which of the runs of ``n`` words of ``a`` equal, word for word, their partners in ``b``; a share of the runs at a time."""
    i, j = (x[:, None] + np.arange(n) for x in (at, to))
    lengths = a.ends[i] - a.starts[i]
    if len(at) > 1 and lengths.sum() > CHUNK_BYTES:
        half = len(at) // 2
        return np.r_[same_runs(a, at[:half], b, to[:half], n), same_runs(a, at[half:], b, to[half:], n)]
    out = (lengths == b.ends[j] - b.starts[j]).all(1)
    lengths = lengths[out].ravel()
    differ = _bytes_of(a, i[out].ravel(), lengths) != _bytes_of(b, j[out].ravel(), lengths)
    out[np.flatnonzero(out)[np.repeat(np.arange(len(lengths)), lengths)[differ] // n]] = False
    return out


class Index:
    """What is known of one block of items: fingerprints, spans by hash with their items, and short items by length."""

    def __init__(self, ids: list[str], texts: list[str | None], span: int = SPAN, k: int = K):
        self.text = text = Words(*utf8(pa.array(texts, pa.string())))
        hashes, bounds = text.hashes, text.bounds
        self.ids, self.span, self.k = ids, span, k
        self.prints = np.unique(fingerprints(hashes, bounds, span, k)[1])
        lengths = np.diff(bounds)
        owner = np.repeat(np.arange(len(ids)), lengths)
        at = np.flatnonzero(run_starts(bounds, span, len(hashes)))
        self.spans = self._postings(gram_hashes(hashes, span)[at], owner[at], at, span)
        self.short = {}
        for n in sorted({int(x) for x in lengths if 0 < x < span}):
            mine = np.flatnonzero(lengths == n)
            self.short[n] = self._postings(gram_hashes(hashes, n)[bounds[mine]], mine, bounds[mine], n)
        text.hashes = None

    def _postings(self, keys: np.ndarray, items: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys, the start of each one's items, the items, and where each has those words; a run that an item repeats counts once."""
        order = np.lexsort((at, items, keys))
        keys, items, at = keys[order], items[order], at[order]
        if len(keys):
            again = np.flatnonzero((keys[1:] == keys[:-1]) & (items[1:] == items[:-1])) + 1
            keep = np.ones(len(keys), bool)
            keep[again[same_runs(self.text, at[again], self.text, at[again - 1], n)]] = False
            keys, items, at = keys[keep], items[keep], at[keep]
        found, start = np.unique(keys, return_index=True)
        return found, np.r_[start, len(items)].astype(np.int64), items, at

    @staticmethod
    def _find(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Index of each key in the sorted table, else -1."""
        if not len(table):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, -1)

    def hits(self, text: Words) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """For each length: word positions at which a span or short item occurs, that length, and (position's index, item) pairs."""
        hashes, bounds = text.hashes, text.bounds
        at, prints = fingerprints(hashes, bounds, self.span, self.k)
        seeds = at[self._find(prints, self.prints) >= 0]
        if len(seeds):
            ok = run_starts(bounds, self.span, len(hashes))
            near = np.unique((seeds[:, None] - np.arange(self.span - self.k + 1)[None, :]).ravel())
            near = near[(near >= 0) & (near < len(ok))]
            near = near[ok[near]]
            yield self._hit(text, near, gram_hashes(hashes, self.span)[near], self.span, self.spans)
        for n, postings in self.short.items():
            ok = np.flatnonzero(run_starts(bounds, n, len(hashes)))
            yield self._hit(text, ok, gram_hashes(hashes, n)[ok], n, postings)

    def _hit(self, text, at, keys, n, postings):
        table, start, items, places = postings
        found = self._find(keys, table)
        at, found = at[found >= 0], found[found >= 0]
        counts = start[found + 1] - start[found]
        index = np.repeat(np.arange(len(at)), counts)
        within = np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)
        posting = np.repeat(start[found], counts) + within
        same = same_runs(text, at[index], self.text, places[posting], n)
        kept, index = np.unique(index[same], return_inverse=True)
        return at[kept], n, index, items[posting[same]]


FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("hit_spans", T.ArrayType(T.IntegerType())),
]


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Overlapping or touching spans joined: start, end, start, end, ..."""
    out: list[int] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def summary(spans: list[list[int]], items: list[set[str]]) -> dict[str, pa.Array]:
    """Columns of what is hit, from the merged spans and the items of each document."""
    hit = [sum(x[1::2]) - sum(x[::2]) for x in spans]
    return {
        "n_hit": pa.array(hit, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()), "items_sha256": pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()),
        "contaminated": pa.array([h > 0 for h in hit], pa.bool_()), "hit_spans": pa.array(spans, pa.list_(pa.int32())),
    }


def _lookup(shared: Broadcast, text: str):
    """Match documents with the broadcast index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch, data, offsets in chunks(batches, text):
            found = Words(data, offsets)
            bounds = found.bounds
            spans = [[] for _ in range(batch.num_rows)]
            items = [set() for _ in range(batch.num_rows)]
            for at, n, which, item in index.hits(found):
                doc = np.searchsorted(bounds, at, "right") - 1
                for d in np.unique(doc):
                    mine = at[doc == d] - bounds[d]
                    cut = np.flatnonzero(np.diff(mine) > n) + 1
                    spans[d] += [(int(p[0]), int(p[-1]) + n) for p in np.split(mine, cut)]
                for d, i in np.unique(np.stack([doc[which], item]), axis=1).T if len(which) else ():
                    items[d].add(index.ids[i])
            yield with_columns(batch, n_words=pa.array(np.diff(bounds), pa.int64()), **summary([merged(x) for x in spans], items))

    return run


RUN = "owner {}, start int, n int, print long, run binary"


def _runs(span: int, k: int, short: list[int], bits: Broadcast | None):
    """Runs of words as rows (owner, place in the text, length, fingerprint, words joined by one space).

    Of items all windows; of documents the runs of ``span`` words and of each short length whose fingerprint's bit is set.  A run's
    fingerprint is the smallest hash of its k-grams, a short run's is its own.
    """

    def rows(owner: pa.Array, text: Words, at: np.ndarray, n: int, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        doc = np.searchsorted(text.bounds, at, "right") - 1
        words = at[:, None] + np.arange(n)
        size = (text.ends[words] - text.starts[words]).sum(1) + n - 1
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(size) // CHUNK_BYTES)) + 1):
            w = words[part].ravel()
            lengths = text.ends[w] - text.starts[w]
            data = np.insert(_bytes_of(text, w, lengths), np.cumsum(lengths)[:-1], 32) if len(w) else np.zeros(0, np.uint8)
            cut = np.r_[0, np.cumsum(size[part] + 1)]
            runs = pa.array([data[a : b - 1].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
            columns = [owner.take(pa.array(doc[part])), pa.array(at[part] - text.bounds[doc[part]], pa.int32()), pa.array(np.full(len(part), n), pa.int32()), pa.array(prints[part].view(np.int64)), runs]
            yield pa.RecordBatch.from_arrays(columns, names=["owner", "start", "n", "print", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "text"):
            text = Words(data, offsets)
            lengths = np.diff(text.bounds)
            for n in [*short, span]:
                prints = least_grams(text.hashes, span, k)[0] if n == span else gram_hashes(text.hashes, n)
                if bits is None and n < span:
                    at = text.bounds[:-1][lengths == n]
                else:
                    at = np.flatnonzero(run_starts(text.bounds, n, len(text.hashes)))
                if bits is not None:
                    bit = prints[at] >> np.uint64(64 - FILTER_BITS)
                    at = at[(bits.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
                if len(at):
                    yield from rows(batch.column("owner"), text, at, n, prints[at])

    return run


def print_bits(runs: DataFrame) -> np.ndarray:
    """A table of bits, set for the leading bits of every fingerprint; at most 2 ** FILTER_BITS / 64 rows reach the driver."""
    bit = F.shiftrightunsigned("print", 64 - FILTER_BITS)
    one = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    found = runs.select(bit.alias("bit")).distinct().groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(one).alias("set")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[found.column("at").to_numpy()] = found.column("set").to_numpy().view(np.uint64)
    return out


def _spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hit runs and items of a document as its columns."""
    for batch in batches:
        spans = [merged([(x["start"], x["start"] + x["n"]) for x in runs]) for runs in batch.column("runs").to_pylist()]
        yield with_columns(batch.select(["owner"]), **summary(spans, [set(x) for x in batch.column("items").to_pylist()]))


def _joined(base: DataFrame, given: DataFrame, text: str, span: int, k: int) -> DataFrame:
    """Match documents by a join of fingerprints and the words around them; what a text gives depends on the text alone, so its sha256 names it."""
    spark = base.sparkSession
    key = unused(base, "owner")[0]
    keyed = base.withColumn(key, F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)))
    windows = settle(given.select(F.col("i").alias("owner"), F.col("t").alias("text")).mapInArrow(_runs(span, k, list(range(1, span)), None), RUN.format("string")), "windows")
    short = sorted(r["n"] for r in windows.where(F.col("n") < span).select("n").distinct().collect())
    bits = spark.sparkContext.broadcast(print_bits(windows))
    runs = keyed.select(F.col(key).alias("owner"), F.col(text).alias("text")).mapInArrow(_runs(span, k, short, bits), RUN.format("binary")).distinct()
    on = ["print", "n", "run"]
    met = runs.join(windows.select(*on, F.col("owner").alias("item")).distinct(), on)
    schema = T.StructType([T.StructField("owner", T.BinaryType()), *FIELDS[1:]])
    hits = settle(met.groupBy("owner").agg(F.collect_set(F.struct("start", "n")).alias("runs"), F.collect_set("item").alias("items")).mapInArrow(_spans_of, schema), "hits")
    none = {"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256), "contaminated": F.lit(False), "hit_spans": F.array().cast("array<int>")}
    out = keyed.alias("d").join(hits.alias("h"), F.col(f"d.{key}") == F.col("h.owner"), "left")
    marks = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"d.`{text}`"), F.lit("")), WORD, "w"), "[^w]+", "")
    n_words = F.length(marks).cast("long").alias("n_words")
    return out.select(*[F.col(f"d.`{c}`") for c in base.columns], n_words, *[F.coalesce(F.col(f"h.{c}"), v).alias(c) for c, v in none.items()])


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add n_words, n_hit, n_items, items_sha256, contaminated and hit_spans (word positions: start, end, ...) to every row.

    Words are runs of 0-9, A-Z (lower-cased), a-z and all beyond ASCII.  Every run of ``span`` words of an item is
    a window; an item with fewer words, but not none, is one window.  A document word inside any occurrence
    of a window is hit; n_items counts the different item ids with occurring windows.  Hashes only find candidates: what counts
    is that the words are equal.  Null and empty texts have no words; texts and words may be of any length.  Null item ids
    count as the id ``null``; repeated rows and ids are one item.  With no items or no documents nothing is hit.  A column of
    ``docs`` named like an added one is replaced.

    Items without words are left out, and the size of the others' texts and ids is summed first, with ITEM_BYTES for each.  An index of up to ``block_bytes`` of them is sent to the executors: one scan of
    the documents and no shuffle, however often a passage repeats.  Beyond that, fingerprints of documents and items are joined together
    with the words around them; a table of bits of fixed size first drops document fingerprints that no item has, so what moves is
    little more than the hits, and then, to bring the hits back, each row once.
    """
    base = without(docs, [f.name for f in FIELDS])
    given = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.coalesce(item_text, F.lit("")).alias("t")).where(F.col("t").rlike(WORD)).distinct()
    if given.agg(F.coalesce(F.sum(F.octet_length("t") + F.octet_length("i") + ITEM_BYTES), F.lit(0)).alias("n")).collect()[0]["n"] > block_bytes:
        return _joined(base, given, text, span, k)
    rows = given.collect()
    index = Index([r["i"] for r in rows], [r["t"] for r in rows], span, k)
    return base.mapInArrow(_lookup(docs.sparkSession.sparkContext.broadcast(index), text), appended(base.schema, FIELDS))


def op7_winnowing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM win),
dw AS (SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, greatest(len(w) - n, -1) + 2)) AS i FROM d, ns)),
h AS (SELECT DISTINCT rid, i, dw.n, item FROM dw JOIN win ON win.g = dw.g AND win.n = dw.n),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
