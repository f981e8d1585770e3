"""Removal of long repeated byte strings across all texts by suffix sorting.

Texts are never sorted whole.  In every window of ``span`` bytes the smallest hash of a short run is its anchor, so
equal windows have equal anchors; windows whose anchor occurs once in all texts cannot repeat.  The
stretches around the other anchors are dealt out by anchor, and each task sorts the suffixes of its stretches in two
stages: those smaller than their successors directly, the rest induced from them by one scan over the buckets of
first bytes.  Adjacent common prefixes of ``span`` bytes then tell which windows are equal.

An anchor with very many stretches is dealt to many tasks, which drop equal ones, and then lengthened by bytes to its
left or right, which its windows must share to be equal, until it is rare or as long as a window.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirloom.llm.common import _BASE, _BYTE, _UNBASE, chunks, discard, mixed, powers, settle, settle_bucketed, span_hashes, utf8

#: Bytes of a repeated string, and of the runs whose hashes are anchors.
SPAN, RUN = 100, 32

#: Bytes of stretches that are sorted together; stretches of one anchor stay together.
SORT_BYTES = 2 << 20

#: Stretches of one anchor beyond which it is lengthened, and the tasks that such an anchor is dealt to.
HOT, SALTS = 16_384, 64

#: Low bits that hold a position beside the high bits of its hash.
PLACE = np.uint64((1 << 31) - 1)

#: A byte that no UTF-8 text holds: it ends a stretch and is larger than all others.
END = 0xFF


def anchored(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: its hash, the text, the first and last window's start in the text, and the anchor's start there."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < span:
        return np.zeros(0, np.uint64), none, none, none, none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, n), out=sums[1:])
    grams = mixed((sums[run:] - sums[:-run]) * powers(_UNBASE, n + 1)[: n - run + 1])
    low = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    wide, width = 1, span - run + 1
    while 2 * wide <= width:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    if wide < width:
        low = np.minimum(low[: len(low) - (width - wide)], low[width - wide :])
    at = np.flatnonzero(_inside(offsets, n, span))
    anchor = (low[at] & PLACE).astype(np.int64)
    text = np.searchsorted(offsets, at, "right") - 1
    cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]) if len(at) else none
    last = np.r_[cut[1:], len(at)] - 1 if len(at) else none
    base = offsets[text[cut]]
    return grams[anchor[cut]], text[cut], at[cut] - base, at[last] - base, anchor[cut] - base


def lengthened(data: np.ndarray, offsets: np.ndarray, f: np.ndarray, at: np.ndarray, slack: int, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """Stretches of longer anchors in place of those given: row, first and last byte's end, anchor's hash and its start in the stretch.

    ``at``: where the anchor of ``span - slack`` bytes starts in each stretch.  Of a window's bytes beside the anchor, half
    or more are on one side; so each stretch splits into windows that go on far enough to the left and the others,
    which go on to the right: every window is in one of the two.
    """
    size, base = np.diff(offsets), offsets[:-1]
    if slack == 0:
        return np.arange(len(size)), np.zeros(len(size), np.int64), size, f, at
    half, core = (slack + 1) // 2, span - slack
    left = np.flatnonzero(at >= half)
    begin = np.maximum(0, at - half + 1)
    right = np.flatnonzero(begin <= size - span)
    row = np.r_[left, right]
    starts = np.r_[at[left] - half, at[right]]
    seal = span_hashes(data, base[row] + starts, base[row] + starts + core + half)
    side = np.repeat(np.array([1, 2], np.uint64), [len(left), len(right)])
    key = mixed(seal + mixed(f[row].view(np.uint64) + side)).view(np.int64)
    first = np.r_[np.zeros(len(left), np.int64), begin[right]]
    last = np.r_[np.minimum(size[left], at[left] - half + span), size[right]]
    return row, first, last, key, starts - first


def _inside(offsets: np.ndarray, n: int, span: int) -> np.ndarray:
    """Mask of the window starts 0..n-span that stay within one text."""
    edge = np.zeros(n + 1, np.int32)
    ends = offsets[1:-1]
    np.add.at(edge, np.maximum(ends - span + 1, 0), 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge)[: n - span + 1] == 0


def suffix_order(text: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in suffix order, and the packed bytes at every position.

    ``text``: stretches that END closes.  ``wanted``: mask of positions; each wanted run is widened to the next
    suffix that is smaller than its successor, so that every other has its successor among them.  Order
    is exact to SPAN bytes; suffixes equal so far are adjacent in any order.
    """
    n = len(text)
    turn = np.flatnonzero(np.r_[text[1:] != text[:-1], True])
    following = turn[np.searchsorted(turn, np.arange(n))] + 1
    padded = np.r_[text, np.full(SPAN + 8, END, np.uint8)]
    small = padded[following] > text
    small[text == END] = True
    stops = np.flatnonzero(small)
    fence = np.zeros(n + 1, np.int32)
    runs = np.flatnonzero(wanted & ~np.r_[wanted[1:], False])
    np.add.at(fence, runs, 1)
    np.add.at(fence, stops[np.searchsorted(stops, runs)] + 1, -1)
    chosen = wanted | (np.cumsum(fence)[:n] > 0)

    packed = np.zeros(n + SPAN, np.uint64)
    for k in range(8):
        packed = (packed << np.uint64(8)) | padded[k : k + n + SPAN]

    # stage one: the chosen suffixes smaller than their successors, by eight bytes at a time
    first = np.flatnonzero(chosen & small)
    order = np.argsort(packed[first], kind="stable")
    first = first[order]
    key = packed[first]
    fresh = np.r_[True, key[1:] != key[:-1]] if len(first) else np.zeros(0, bool)
    for depth in range(8, SPAN, 8):
        tied = ~fresh | ~np.r_[fresh[1:], True]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(fresh)[at]
        word = packed[np.minimum(first[at] + depth, len(packed) - 1)]
        order = np.lexsort((word, group))
        first[at] = first[at[order]]
        word, group = word[order], group[order]
        fresh[at[1:]] |= word[1:] != word[:-1]

    # stage two: larger ones enter their bucket when the scan reaches their successor
    bucket = text[first]
    starts = np.searchsorted(bucket, np.arange(257))
    coming: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def hand_on(done: np.ndarray, own: int) -> np.ndarray:
        before = done[done > 0] - 1
        before = before[chosen[before] & ~small[before]]
        head = text[before]
        mine = before[head == own]
        rest, head = before[head != own], head[head != own]
        by = np.argsort(head, kind="stable")
        rest, head = rest[by], head[by]
        for part in np.split(rest, np.flatnonzero(np.diff(head)) + 1) if len(rest) else ():
            coming[text[part[0]]].append(part)
        return mine

    for c in range(256):
        parts = coming[c]
        now = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        while len(now):
            out.append(now)
            now = hand_on(now, c)
        direct = first[starts[c] : starts[c + 1]]
        if len(direct):
            out.append(direct)
            hand_on(direct, c)
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), packed


def shared_prefix(order: np.ndarray, packed: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Whether each suffix and the one before it share ``span`` bytes."""
    same = np.zeros(len(order), bool)
    live = np.arange(1, len(order))
    for depth in [*range(0, span - 7, 8), *([span - 8] if span % 8 else [])]:
        live = live[packed[order[live] + depth] == packed[order[live - 1] + depth]]
    same[live] = True
    return same


def later_windows(stretches: np.ndarray, offsets: np.ndarray, text_key: np.ndarray, begin: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Stretch and offset of every window that equals one that starts earlier (smaller text key, or there earlier).

    ``begin``: where each stretch starts in its text.
    """
    sizes = np.diff(offsets)
    count = len(sizes)
    text = np.full(len(stretches) + count, END, np.uint8)
    owner = np.repeat(np.arange(count), sizes)
    place = np.arange(len(stretches)) + owner
    text[place] = stretches
    head = offsets[:-1] + np.arange(count)
    wanted = np.zeros(len(text), bool)
    wanted[place[np.arange(len(stretches)) <= np.repeat(offsets[1:], sizes) - span]] = True
    order, packed = suffix_order(text, wanted)
    order = order[wanted[order]]
    group = np.cumsum(~shared_prefix(order, packed, span))
    which = np.searchsorted(head, order, "right") - 1
    offset = order - head[which]
    by = np.lexsort((begin[which] + offset, text_key[which], group))
    group, which, offset = group[by], which[by], offset[by]
    later = np.r_[False, group[1:] == group[:-1]] if len(group) else np.zeros(0, bool)
    return which[later], offset[later]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans joined where they overlap or touch."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.r_[True, starts[1:] > ends[:-1]]
    at = np.flatnonzero(fresh)
    return starts[at], ends[np.r_[at[1:], len(starts)] - 1]


def _anchors(span: int, run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            f, text, lo, _, _ = anchored(data, offsets, span, run)
            rid = batch.column("rid").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(rid[text]), pa.array(lo.astype(np.int32))], names=["f", "rid", "lo"])

    return go


def binaries(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def salted(rid: np.ndarray, hot: np.ndarray, salts: int) -> np.ndarray:
    """A salt from 0 for stretches of hot anchors, -1 for others."""
    return np.where(hot, (mixed(rid.view(np.uint64)) % np.uint64(salts)).astype(np.int32), np.int32(-1)).astype(np.int32)


def _stretches(span: int, run: int, salts: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            f, text, lo, hi, _ = anchored(data, offsets, span, run)
            chosen = batch.column("los")
            rows = np.repeat(np.arange(batch.num_rows), np.asarray(chosen.value_lengths()))
            wide = np.int64(1) << np.int64(32)
            mine, los = text * wide + lo, np.asarray(chosen.flatten()).astype(np.int64)
            hot = np.isin(mine, rows[los < 0] * wide + ~los[los < 0])
            keep = hot | np.isin(mine, rows[los >= 0] * wide + los[los >= 0])
            f, text, lo, hi, hot = f[keep], text[keep], lo[keep], hi[keep], hot[keep]
            size = hi - lo + span
            cuts = np.r_[0, np.cumsum(size)]
            index = np.arange(cuts[-1]) + np.repeat(offsets[text] + lo - cuts[:-1], size)
            rid = batch.column("rid").to_numpy()[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(f.view(np.int64)), pa.array(salted(rid, hot, salts)), binaries(data[index], cuts), pa.array(rid), pa.array(lo.astype(np.int32))],
                names=["f", "salt", "seg", "rid", "lo"],
            )

    return go


def _sorted_tasks(span: int, run: int, limit: int, slack: int):
    """Rows come sorted by anchor, salt, stretch, text and place.  Equal stretches are adjacent: those after the first repeat it
    wholly and stream past.  The different ones of an anchor are suffix-sorted together; those of a hot one
    (salt from 0) leave with longer anchors."""
    names = ["rid", "s", "e", "f", "seg", "at"]

    def spans(rid, s, e):
        empty = [pa.nulls(len(rid), t) for t in (pa.int64(), pa.binary(), pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32()), *empty], names=names)

    def longer(data, offsets, f, at, rid, lo):
        if at is None:
            _, text, _, _, at = anchored(data, offsets, span, run)
            at = at[np.searchsorted(text, np.arange(len(f)))]
        row, first, last, key, at = lengthened(data, offsets, f, at, slack, span)
        cuts = np.r_[0, np.cumsum(last - first)]
        index = np.arange(cuts[-1]) + np.repeat(offsets[row] + first - cuts[:-1], last - first)
        place = (lo[row] + first).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(rid[row]), pa.array(place), pa.nulls(len(row), pa.int32()), pa.array(key), binaries(data[index], cuts), pa.array(at.astype(np.int32))],
            names=names,
        )

    def flush(parts):
        bytes_ = np.concatenate([p[0] for p in parts])
        sizes, rid, lo = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
        which, offset = later_windows(bytes_, np.r_[0, np.cumsum(sizes)], rid, lo, span)
        if not len(which):
            return
        order = np.lexsort((offset, which))
        which, offset = which[order], offset[order]
        cut = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1)])
        last = np.r_[cut[1:], len(which)] - 1
        yield spans(rid[which[cut]], lo[which[cut]] + offset[cut], lo[which[cut]] + offset[last] + span)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = (None, None, None)
        parts: list[tuple] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            f, salt, rid, lo = (batch.column(c).to_numpy() for c in ("f", "salt", "rid", "lo"))
            col = batch.column("seg")
            offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
            data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            seal = span_hashes(data, offsets[:-1], offsets[1:])
            again = np.r_[(f[0], salt[0], seal[0]) == before, (f[1:] == f[:-1]) & (salt[1:] == salt[:-1]) & (seal[1:] == seal[:-1])]
            before = (f[-1], salt[-1], seal[-1])
            size = np.diff(offsets)
            if again.any():
                yield spans(rid[again], lo[again], lo[again] + size[again])
            hot = np.flatnonzero(~again & (salt >= 0))
            if len(hot):
                cuts = np.r_[0, np.cumsum(size[hot])]
                index = np.arange(cuts[-1]) + np.repeat(offsets[hot] - cuts[:-1], size[hot])
                at = batch.column("at").to_numpy()[hot].astype(np.int64) if "at" in batch.schema.names else None
                yield longer(data[index], cuts, f[hot], at, rid[hot], lo[hot])
            new = np.flatnonzero(~again & (salt < 0))
            if not len(new):
                continue
            # cut before the last anchor of the batch: it may go on in the next one
            heads = np.flatnonzero(np.r_[True, f[new][1:] != f[new][:-1]])
            pieces, at = [], 0
            for h in heads[1:]:
                if offsets[new[h]] - offsets[new[at]] + held > limit:
                    pieces.append((at, h))
                    at, held = h, 0
            pieces.append((at, len(new)))
            for i, (a, b) in enumerate(pieces):
                mine = new[a:b]
                index = np.arange(size[mine].sum()) + np.repeat(offsets[mine] - np.r_[0, np.cumsum(size[mine])[:-1]], size[mine])
                part = (data[index], size[mine], rid[mine], lo[mine], f[mine])
                if i == 0 and parts and parts[-1][4][-1] != part[4][0] and held + len(index) > limit and len(pieces) == 1:
                    yield from flush(parts)
                    parts, held = [], 0
                parts.append(part)
                held += len(index)
                if i < len(pieces) - 1:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)

    return go


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        removed, runs, digest, found = [], [], [], []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            s, e = merged(np.array([x["s"] for x in spans], np.int64), np.array([x["e"] for x in spans], np.int64))
            own = data[offsets[i] : offsets[i + 1]]
            edge = np.zeros(len(own) + 1, np.int32)
            edge[s] += 1
            edge[e] -= 1
            left = own[np.cumsum(edge)[:-1] == 0]
            removed.append(len(own) - len(left))
            runs.append(len(s))
            digest.append(hashlib.sha256(left.tobytes()).hexdigest())
            found.append(np.stack([s, e], axis=1).ravel().astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("k"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(found, pa.list_(pa.int32()))],
            names=["k", "removed", "runs", "digest", "cuts"],
        )


def _often(rows: DataFrame, hot: int) -> DataFrame:
    """Anchors that occur twice or more, and whether they are hot."""
    return rows.groupBy("f").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("f", (F.col("c") > hot).alias("hot"))


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", span: int = SPAN, run: int = RUN, limit: int = SORT_BYTES, hot: int = HOT, salts: int = SALTS) -> DataFrame:
    """A row for each row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256 and removed_spans (byte positions: start, end, ...).

    Removed is every byte that a string of ``span`` bytes covers which also starts earlier: in a text of a smaller
    key, or earlier in the same.  Null texts count as empty; null keys come last.  Rows of one key and the same
    text don't remove from each other; different texts of one key are ordered by their SHA-256.
    Strings shorter than ``span`` never count, so no shorter text loses anything.

    Copies of whole texts are set aside first (all of a copy goes if it is long enough), so a group of
    copies of any size costs no sorting.  The different texts are written once, bucketed, and read back for each
    step without a shuffle.  Stretches of an anchor with more than ``hot`` of them are dealt to ``salts`` tasks, which
    remove those equal to one before in their share, and then to the tasks of longer anchors; after at most as many rounds
    as halve ``span - run`` to 0, windows of one anchor are equal and a task has at most one from each share.
    So a task holds at most ``limit`` bytes and the stretches of one anchor that is not hot.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    source = docs.select(F.col(key).alias("id"), raw.alias("raw")).select("id", F.octet_length("raw").cast("long").alias("n"), F.sha2("raw", 256).alias("sha"), F.col("raw").cast("string").alias("text"))
    source = source.withColumn("k", F.concat_ws(":", "sha", F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    meta = settle(source.drop("text"), "texts")
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("k"))).alias("m")
    order = meta.groupBy("sha", "n").agg(first).select("n", F.col("m.id").alias("id"), F.col("m.k").alias("k"))
    order = order.repartitionByRange(F.col("id").asc_nulls_last(), "k").sortWithinPartitions(F.col("id").asc_nulls_last(), "k")
    classes = settle(order.select("n", "k", F.monotonically_increasing_id().alias("rid")), "classes")
    again = meta.groupBy("k").count().where("count > 1").limit(1).count()
    long = source.where(F.col("n") >= span).select("k", "text").join(classes.where(F.col("n") >= span).select("k", "rid"), "k")
    texts = settle_bucketed(long.dropDuplicates(["k"]) if again else long, "long_texts", "k")

    anchors = texts.select("rid", "text").mapInArrow(_anchors(span, run), "f bigint, rid bigint, lo int")
    often = settle(_often(anchors, hot), "often")
    lo = F.when(F.col("hot"), F.bitwise_not("lo")).otherwise(F.col("lo"))
    wanted = settle(anchors.join(often, "f").groupBy("rid").agg(F.collect_list(lo).alias("los")), "anchors")
    discard(often)
    wanted = wanted.join(classes.select("rid", "k"), "rid").select("k", "los")
    salts, slack = min(salts, hot), span - run
    around = texts.join(wanted, "k").select("rid", "text", "los").mapInArrow(_stretches(span, run, salts), "f bigint, salt int, seg binary, rid bigint, lo int")
    found, used = [], []
    while True:
        dealt = around.repartition("f", "salt").sortWithinPartitions("f", "salt", "seg", "rid", "lo")
        done = settle(dealt.mapInArrow(_sorted_tasks(span, run, limit, slack), "rid bigint, s int, e int, f bigint, seg binary, at int"), "spans")
        found.append(done.where("f is null").select("rid", "s", "e"))
        rest = done.where("f is not null").select("f", "seg", "rid", F.col("s").alias("lo"), "at")
        if rest.isEmpty():
            break
        slack -= (slack + 1) // 2
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64("rid"), F.lit(salts))).otherwise(-1).cast("int").alias("salt")
        used.append(settle(_often(rest, hot), "often"))
        around = rest.join(used[-1], "f").select("f", salt, "seg", "rid", "lo", "at")
    discard(*used)
    spans = functools.reduce(DataFrame.unionByName, found)
    lists = spans.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans")).join(classes.select("rid", "k"), "rid").select("k", "spans")
    cut = texts.join(lists, "k").select("k", "text", "spans").mapInArrow(_cut, "k string, removed bigint, runs bigint, digest string, cuts array<int>")
    copy = F.col("own").isNull() & (F.col("n") >= span)
    out = meta.join(classes.select("k", F.col("rid").alias("own")), "k", "left").join(cut, "k", "left")
    return out.select(
        F.col("id").alias(key), F.col("n").alias("n_bytes"), F.when(copy, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("digest", "sha")).alias("kept_sha256"),
        F.when(copy, F.array(F.lit(0), F.col("n").cast("int"))).otherwise(F.coalesce("cuts", F.array().cast("array<int>"))).alias("removed_spans"),
    )


def op10_suffix_sort(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_spans(docs).drop("removed_spans")


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, b, h[2 * b + 1 : 2 * b + 1198] AS p FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99, 500)) AS b FROM d WHERE length(h) >= 200)),
w AS (SELECT doc_id, b + j AS i, md5(p[2 * j + 1 : 2 * j + 200]) AS g FROM (SELECT doc_id, b, p, unnest(range(0, least(500, length(p) // 2 - 99))) AS j FROM b)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
e AS (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 101) > 100 AS fresh FROM r),
f AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM f GROUP BY 1, 2),
k AS (SELECT s.doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS z, h FROM s JOIN d USING (doc_id)),
t AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(h[2 * z + 1 : 2 * a], '' ORDER BY a) || any_value(h)[2 * max(b) + 1 :] AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""
