"""Near-duplicate texts: n-gram Jaccard join through a MinHash LSH forest, verified exactly.

A tree of the forest orders the texts by a label, some MinHash values one after the other; texts below one node of its prefix trie have a
prefix of their labels in common.  The tries are kept as tables of nodes.  The join starts at the leaves and
shortens the prefixes by one value a round, where a node joins texts that no deeper one has, until pairs of the least similarity
have met with the target recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heirloom.llm.common import chunks, discard, gram_hashes, mixed, run_starts, settle, unused, words
from heirloom.llm.components import components

#: Words of a shingle; least Jaccard similarity of a link.
N, LEAST = 5, 0.8

#: Trees of the forest, the MinHash values of a label, and the recall that a pair of the least similarity must have.
TREES, DEPTH, RECALL = 24, 6, 0.9999

#: Probability with which a pair of the least similarity may fail the comparison of its signatures.
MISS = 1e-6

#: Texts of a candidate group that one task holds, and how many times as many stream by it.
BLOCK, STREAM = 512, 8

#: A chain of more than a block's texts counts as loose if no node of the forest holds one in so many of them.
LOOSE = 16


def shingles(hashes: np.ndarray, bounds: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin.

    A text of fewer than n words, but not none, has one shingle of all its words.
    """
    ok = run_starts(bounds, n, len(hashes))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    grams, text = gram_hashes(hashes, n)[ok], owner[: len(ok)][ok]
    lengths = np.diff(bounds)
    for k in sorted({int(x) for x in lengths if 0 < x < n}):
        few = np.flatnonzero(lengths == k)
        grams, text = np.r_[grams, gram_hashes(hashes, k, seed=k + 2)[bounds[few]]], np.r_[text, few]
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[keep], text[keep]
    return grams, np.searchsorted(text, np.arange(len(bounds)))


def set_keys(grams: np.ndarray, bounds: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """16 bytes that tell shingle sets apart; texts without words are told apart by their bytes."""
    sums = np.zeros((2, len(grams) + 1), np.uint64)
    np.cumsum(mixed(grams), out=sums[0, 1:])
    np.cumsum(mixed(grams ^ np.uint64(0xA0761D6478BD642F)), out=sums[1, 1:])
    keys = np.stack([s[bounds[1:]] - s[bounds[:-1]] for s in sums], axis=1)
    for i in np.flatnonzero(np.diff(bounds) == 0):
        raw = data[offsets[i] : offsets[i + 1]].astype(np.uint64)
        at = np.arange(1, len(raw) + 1, dtype=np.uint64)
        keys[i] = [np.sum(mixed(raw + (at << np.uint64(9)))), len(raw)]
    return keys


def signatures(grams: np.ndarray, bounds: np.ndarray, hashes: int) -> np.ndarray:
    """16 bits of the MinHash under each of ``hashes`` permutations; 0 for empty sets."""
    rows = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, hashes), np.uint16)
    if len(rows):
        starts = bounds[rows]
        factors = mixed(np.arange(1, hashes + 1, dtype=np.uint64)) | np.uint64(1)
        for k in range(hashes):
            least = np.minimum.reduceat(grams * factors[k], starts)
            out[rows, k] = (mixed(least) >> np.uint64(48)).astype(np.uint16)
    return out


def binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as its bytes."""
    wide = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * wide, wide, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def shortest_prefix(trees: int, depth: int, recall: float, least: float) -> int:
    """The longest prefix, ``depth`` at most, of which pairs of the least similarity share one in some tree with probability ``recall``."""
    for d in range(depth, 0, -1):
        if 1 - (1 - least**d) ** trees >= recall:
            return d
    raise ValueError(f"{trees} trees reach a recall of {1 - (1 - least) ** trees:.6f} at similarity {least}; {recall} was asked for")


def surely_equal(hashes: int, least: float, miss: float = MISS) -> int:
    """The most equal values of ``hashes`` that a pair of the least similarity has but for a probability of ``miss``: the tail of the binomial law."""
    below = 0.0
    for k in range(hashes + 1):
        chance = math.lgamma(hashes + 1) - math.lgamma(k + 1) - math.lgamma(hashes - k + 1)
        below += math.exp(chance + k * math.log(least) + (hashes - k) * math.log(1 - least)) if least < 1 else float(k == hashes)
        if below > miss:
            return k
    return hashes


def _signed(text: str, n: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, text):
            found, _, bounds = words(data, offsets)
            grams, cuts = shingles(found, bounds, n)
            sig = binary(signatures(grams, cuts, hashes))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), binary(set_keys(grams, cuts, data, offsets)), pa.array(np.diff(cuts), pa.int32()), sig], names=["id", "row", "cls", "n", "sig"])

    return run


def _shingled(text: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, text):
            found, _, bounds = words(data, offsets)
            grams, cuts = shingles(found, bounds, n)
            sets = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(grams.view(np.int64)))
            yield pa.RecordBatch.from_arrays([binary(set_keys(grams, cuts, data, offsets)), sets], names=["key", "grams"])

    return run


class _Block:
    """The texts that a task holds, and how others compare with them.

    ``tree``: the texts are those of a node of that tree, and of these only such link as have no node of an earlier tree in common, so
    that pairs that meet in several trees link once; -1: they are those of a whole chain.
    """

    def __init__(self, least: float, exact: bool, tree: int = -1):
        self.least, self.exact, self.tree = least, exact, tree
        self.heads: list[np.ndarray] = []
        self.keys: list[bytes] = []
        self.parts: list[np.ndarray] = []
        self.m: list[int] = []

    def add(self, key, m, value, head):
        self.keys.append(key)
        self.m.append(m)
        self.parts.append(value)
        if self.tree > 0:
            self.heads.append(head)

    def ready(self):
        self.up = np.arange(len(self.keys))
        self.links = np.zeros(len(self.keys), np.int64)
        self.weight = np.array(self.m, np.int64)
        if self.exact:
            self.sizes = np.array([len(p) for p in self.parts])
            owner = np.repeat(np.arange(len(self.parts)), self.sizes)
            grams = np.concatenate(self.parts)
            order = np.argsort(grams, kind="stable")
            self.owner = owner[order]
            self.grams, self.start = np.unique(grams[order], return_index=True)
            self.start = np.r_[self.start, len(order)]
        else:
            self.sig = np.stack(self.parts)
        if self.tree > 0:
            self.head = np.stack(self.heads)
        self.parts, self.heads = [], []
        self.place = {k: i for i, k in enumerate(self.keys)}

    def near(self, key: bytes, value: np.ndarray, head: np.ndarray | None = None) -> np.ndarray:
        """The held texts that link with one that streams by."""
        if self.exact:
            at = np.minimum(np.searchsorted(self.grams, value), len(self.grams) - 1)
            at = at[self.grams[at] == value]
            if not len(at):
                return at
            counts = self.start[at + 1] - self.start[at]
            index = np.arange(counts.sum()) + np.repeat(self.start[at] - np.r_[0, np.cumsum(counts)[:-1]], counts)
            both = np.bincount(self.owner[index], minlength=len(self.keys))
            close = both >= self.least * (self.sizes + len(value) - both) - 1e-9
            close &= both > 0
        else:
            close = (self.sig == value).sum(1) >= self.least
        if key in self.place:
            close[self.place[key]] = False
        found = np.flatnonzero(close)
        if self.tree > 0 and len(found):
            found = found[~(self.head[found, : self.tree] == head[: self.tree]).any(1)]
        return found

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, found: np.ndarray, weight: int) -> int:
        self.links[found] += weight
        tops = np.unique(self.up[found])
        r = min(self.root(t) for t in tops)
        if len(tops) > 1 or self.up[tops[0]] != r:
            for t in tops:
                self.up[self.root(t)] = r
            self.up[found] = r
        return r


def _compared(least: float, exact: bool):
    """Rows sorted by group, block and share, held texts (role 0) before those that stream by (role 1): key, links of held texts, and edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "links", "other"]
        block, group, open_ = _Block(least, exact), None, True
        heads: list = []

        def closed():
            if block.keys and not open_:
                yield pa.RecordBatch.from_arrays([pa.array(block.keys, pa.binary()), pa.array(block.links), pa.array([block.keys[block.root(i)] for i in range(len(block.keys))], pa.binary())], names=names)

        for batch in batches:
            comp, role = batch.column("comp").to_pylist(), batch.column("role").to_pylist()
            part = list(zip(comp, batch.column("b").to_pylist(), batch.column("s").to_pylist(), strict=True))
            keys, m = batch.column("key").to_pylist(), batch.column("m").to_pylist()
            if exact:
                col = batch.column("value")
                cuts, flat = np.asarray(col.offsets), np.asarray(col.values).view(np.uint64)
                values = [flat[cuts[i] : cuts[i + 1]] for i in range(batch.num_rows)]
                trees = batch.column("tree").to_pylist()
                heads = [np.frombuffer(h, np.uint64) if t > 0 else None for h, t in zip(batch.column("heads").to_pylist(), trees, strict=True)]
            else:
                trees, heads = [-1] * batch.num_rows, [None] * batch.num_rows
                values = [np.frombuffer(v, np.uint16) for v in batch.column("value").to_pylist()]
            out_key, out_other = [], []
            for i in range(batch.num_rows):
                if part[i] != group:
                    yield from closed()
                    block, group, open_ = _Block(least, exact, trees[i]), part[i], True
                if role[i] == 0:
                    block.add(keys[i], m[i], values[i], heads[i])
                    continue
                if open_:
                    if not block.keys:
                        continue
                    block.ready()
                    open_ = False
                found = block.near(keys[i], values[i], heads[i])
                if len(found):
                    out_key.append(keys[i])
                    out_other.append(block.keys[block.join(found, m[i])])
            if out_key:
                yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.binary()), pa.array(np.zeros(len(out_key), np.int64)), pa.array(out_other, pa.binary())], names=names)
        yield from closed()

    return run


def compare_groups(rows: DataFrame, least: float, exact: bool, block: int = BLOCK) -> DataFrame:
    """Compare all texts of each group: rows comp, nc (its number of texts), key, m, value (shingles or signature; with shingles also tree and heads, as ``_Block`` has them) to key, links, other.

    A group is cut into blocks and, otherwise, into shares of STREAM times that many texts.  For each block and
    share a task holds the block while the share streams by, so that its rows and memory are bounded. Links are counted
    and chained to a forest where they are found: pairs never become rows.  ``least`` is the similarity of a link or, for signatures, the
    number of equal values.
    """
    rows = rows.withColumns({c: F.ceil(F.col("nc") / n).cast("int") for c, n in (("nb", block), ("ns", STREAM * block))})
    own, share = F.pmod(F.xxhash64("key"), F.col("nb")).cast("int"), F.pmod(F.xxhash64("key", F.lit(1)), F.col("ns")).cast("int")
    cell = lambda role, b, s: F.struct(F.lit(role).alias("role"), b.alias("b"), s.alias("s"))
    held = F.transform(F.sequence(F.lit(0), F.col("ns") - 1), lambda s: cell(0, own, s))
    streamed = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda b: cell(1, b, share))
    dealt = rows.withColumn("__c", F.explode(F.concat(held, streamed))).select("comp", "__c.b", "__c.s", "__c.role", "key", "m", "value", *(["tree", "heads"] if exact else []))
    dealt = dealt.repartition("comp", "b", "s").sortWithinPartitions("comp", "b", "s", "role")
    return dealt.mapInArrow(_compared(least, exact), "key binary, links bigint, other binary")


def _met(classes: DataFrame, trees: int, depth: int, floor: int, block: int, sure: int) -> DataFrame:
    """Descend the forest: ``node`` and ``root`` of the texts that chains of pairs join, each pair under a common prefix and with ``sure`` equal values.

    Round d looks at the nodes of prefixes of d values, ``depth`` first, ``floor`` last.  Only nodes count
    whose texts are not yet in one chain; so what deeper nodes have matched is not compared again, and where
    they have matched all, the prefix is not shortened.  Nodes are counted by partial sums, and one of many texts is dealt to
    many tasks (``compare_groups``).
    """
    width = 2 * depth
    labels = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.substring(F.col("sig"), (t * width + 1).cast("int"), F.lit(width)).alias("label")))
    leaves = classes.where("n > 0").select("cls", F.explode(labels).alias("leaf")).select("cls", F.col("leaf.tree").alias("tree"), F.col("leaf.label").alias("label"))
    edges, roots = None, None
    for d in range(depth, floor - 1, -1):
        at = leaves.withColumn("comp", F.xxhash64("tree", F.substring("label", 1, 2 * d))).select("comp", "cls")
        if roots is not None:
            at = at.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("comp", "cls", F.coalesce("root", "cls").alias("root"))
        else:
            at = at.withColumn("root", F.col("cls"))
        nodes = settle(at.groupBy("comp").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("nc")).where("a <> b").select("comp", "nc"), "nodes")
        below = at.select("comp", "cls").join(nodes, "comp")
        rows = below.join(classes.select("cls", "m", F.col("sig").alias("value")), "cls")
        found = compare_groups(rows.select("comp", "nc", F.col("cls").alias("key"), "m", "value"), sure, False, 4 * block).where("key <> other").select(F.col("key").alias("a"), F.col("other").alias("b"))
        now = settle(found if edges is None else found.unionByName(edges), "met")
        discard(nodes, *([] if edges is None else [edges, roots]))
        edges, roots = now, components(now)
    discard(edges)
    return roots


def verification_groups(wanted: DataFrame, classes: DataFrame, trees: int, depth: int, floor: int, block: int) -> DataFrame:
    """Where texts of chains (cls, comp, m, row) are verified: comp, nc, tree, key, m, heads; a text may be in several groups.

    A chain of at most a block's texts, or of which some node of the forest holds one in LOOSE, is a group of its own: a node's texts have ``floor`` values in common, so
    nearly all of them are linked, and comparing the whole chain is in proportion to its links.  Texts of longer, looser chains (drifting families, shared
    templates) are compared within the nodes of the shortest prefix only, so what is compared are pairs that meet there; the groups are the nodes.
    """
    sizes = settle(wanted.groupBy("comp").agg(F.count(F.lit(1)).alias("nc")), "sizes")
    none = [F.lit(-1).alias("tree"), F.lit(None).cast("binary").alias("heads")]
    whole = wanted.join(sizes, "comp").select("comp", "nc", F.col("cls").alias("key"), "m", *none)
    long = sizes.where(F.col("nc") > block)
    if long.isEmpty():
        return whole
    width = 2 * depth
    label = lambda t: F.substring(F.col("sig"), (t * width + 1).cast("int"), F.lit(2 * floor))
    every = F.sequence(F.lit(0), F.lit(trees - 1))
    eight = lambda n: F.unhex(F.lpad(F.hex(n), 16, "0"))
    # eight bytes for each tree's prefix; only whether they are equal counts
    heads = F.aggregate(F.transform(every, lambda t: eight(F.xxhash64(t, label(t)))), F.lit(b""), lambda a, x: F.concat(a, x))
    far = wanted.join(long, "comp").join(classes.select("cls", "sig"), "cls")
    nodes = settle(far.withColumn("tree", F.explode(every)).withColumn("node", F.xxhash64("comp", "tree", label(F.col("tree")))).select("comp", "nc", "cls", "tree", "node"), "places")
    counts = settle(nodes.groupBy("comp", "nc", "node").agg(F.count(F.lit(1)).alias("n")), "counts")
    loose = counts.groupBy("comp", "nc").agg(F.max("n").alias("most")).where(F.col("most") * LOOSE < F.col("nc")).select("comp")
    if loose.isEmpty():
        discard(nodes, counts)
        return whole
    met = nodes.join(loose, "comp").join(counts.where("n > 1").select("node", "n"), "node").select(eight(F.col("node")).alias("comp"), F.col("n").alias("nc"), "tree", "cls")
    apart = met.join(far.select("cls", "m", heads.alias("heads")), "cls").select("comp", "nc", F.col("cls").alias("key"), "m", "tree", "heads")
    return whole.join(loose, "comp", "left_anti").select(*whole.columns).unionByName(apart)


def linked(source: DataFrame, n: int = N, least: float = LEAST, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Of texts (id, row, text): id, row, cls of each; and of each cls its component, whose ``root`` holds the smallest id and the
    smallest cls that has it, m copies and links to other sets."""
    floor, sure = shortest_prefix(trees, depth, recall, least), surely_equal(trees * depth, least)
    kind = lambda c: source.schema[c].dataType.simpleString()
    signed = settle(source.mapInArrow(_signed("text", n, trees * depth), f"id {kind('id')}, row {kind('row')}, cls binary, n int, sig binary"), "signatures")
    classes = settle(signed.groupBy("cls").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("row").alias("row")), "classes")
    close = _met(classes, trees, depth, floor, block, sure)
    wanted = settle(close.join(classes, close.node == classes.cls).select("cls", F.col("root").alias("comp"), "m", "row"), "wanted")
    groups = verification_groups(wanted, classes, trees, depth, floor, block)
    texts = source.join(wanted.select("row"), "row", "left_semi")
    sets = texts.select("text").mapInArrow(_shingled("text", n), "key binary, grams array<bigint>").groupBy("key").agg(F.first("grams").alias("value"))
    rows = sets.join(groups, "key")
    found = settle(compare_groups(rows.select("comp", "nc", "key", "m", "value", "tree", "heads"), least, True, block), "verified")
    discard(close, wanted)
    links = settle(found.groupBy("key").agg(F.sum("links").alias("links")), "link_counts")
    name = classes.select("cls", "m", F.struct(F.col("id").isNull().alias("none"), "id", "cls").alias("node"))
    ends = found.where("key <> other").select("key", "other").join(name.select(F.col("cls").alias("key"), F.col("node").alias("a")), "key").join(name.select(F.col("cls").alias("other"), F.col("node").alias("b")), "other").select("a", "b")
    roots = components(ends)
    discard(found)
    info = name.join(links, F.col("cls") == links.key, "left").drop("key").join(roots, "node", "left")
    return signed.select("id", "row", "cls"), info.select("cls", "m", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))


def _row(docs: DataFrame, text: str, key: str) -> Column:
    """A name that rows share only if they are equal in all columns."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text, key)]
    return F.md5(F.concat_ws("|", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\x00")), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("\x00")).cast("binary")), *([F.to_json(F.struct(*rest))] if rest else [])))


def near_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """A row for each row of ``docs``: its key, class_id, n_links and kept.

    Texts link if the Jaccard similarity of their sets of n-word shingles is ``least`` or more; words are
    runs of 0-9, A-Z (lower-cased), a-z and all beyond ASCII.  Texts with the same set are copies: they link with
    each other and share all other links, so each set is compared once.  A text without words links with
    texts of the same bytes only; null counts as empty.  Texts of any length are read whole.  n_links counts the other rows that link
    directly, class_id is the smallest key that links reach, the row's own included (null keys are ignored
    unless there is no other), and kept tells whether the row's key is that one.  Repeated rows link with each other.
    No row gives no row.

    Options and steps: MinHash signatures; a forest of ``trees`` tries of labels of ``depth`` values, whose matched prefixes are shortened until
    pairs of similarity ``least`` meet with probability ``recall`` (an error if they can't); pairs that meet and have as many equal values as
    all but MISS of linked pairs do are chained; and the pairs of a chain, of a long loose one those that meet, are verified on their whole shingle sets (``verification_groups``).
    """
    signed, info = linked(docs.select(F.col(key).alias("id"), _row(docs.select(key, text), text, key).alias("row"), F.col(text).alias("text")), **options)
    info = info.select("cls", F.col("root.id").alias("class_id"), (F.col("links") + F.col("m") - 1).cast("long").alias("n_links"))
    return signed.join(info, "cls").select(F.col("id").alias(key), "class_id", "n_links", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """Of each group of rows that links connect (``near_texts``) exactly one stays, with all its columns.

    That is the one with the smallest key (null last); rows of one key are told apart by their values, so rows that share a key or have none are
    lost only to a row of their own group.  Of rows that are equal in all columns one stays.
    """
    row, times = unused(docs, "row", "times")
    named = docs.withColumn(row, _row(docs, text, key))
    signed, info = linked(named.select(F.col(key).alias("id"), F.col(row).alias("row"), F.col(text).alias("text")), **options)
    first = F.min(F.struct(F.col("id").isNull(), "id", "row"))
    of_class = settle(signed.groupBy("cls").agg(first.alias("f")), "firsts")
    kept = of_class.join(info.select("cls", "root"), "cls").groupBy("root").agg(F.min("f").alias("f")).select(F.col("f.row").alias(row))
    kept = settle(kept.join(signed.groupBy(F.col("row").alias(row)).agg(F.count(F.lit(1)).alias(times)), row), "kept")
    found = named.join(kept, row)
    out = found.where(F.col(times) == 1)
    if kept.where(F.col(times) > 1).limit(1).count():
        out = out.unionByName(found.where(F.col(times) > 1).dropDuplicates([row]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_forest_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_texts(docs)


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
x AS (SELECT a.r, b.r AS q, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
p AS (SELECT x.r, x.q FROM x JOIN n a ON a.r = x.r JOIN n b ON b.r = x.q WHERE k >= 0.8 * (a.n + b.n - k) UNION ALL SELECT a.r, b.r FROM d a JOIN d b ON a.text = b.text AND a.r <> b.r WHERE len(a.w) = 0),
c AS (SELECT r, doc_id AS m FROM d UNION SELECT p.q, c.m FROM c JOIN p ON p.r = c.r),
l AS (SELECT r, count(*) AS n FROM p GROUP BY r),
k AS (SELECT r, min(m) AS m FROM c GROUP BY r)
SELECT doc_id, m AS class_id, coalesce(l.n, 0)::BIGINT AS n_links, doc_id IS NOT DISTINCT FROM m AS kept FROM d LEFT JOIN l USING (r) JOIN k USING (r)
"""
