"""Exact range join of vectors in a metric space: pivots cut it into cells that join independently."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirloom.llm.common import discard, settle, without
from heirloom.llm.components import components

#: Home vectors of a cell that one task holds, and how many times as many rows of the cell stream by it.
BLOCK, STREAM = 2048, 4

#: Vectors for each pivot, at least; and the pivots of all groups together, about, at most.
PER_PIVOT, MOST_PIVOTS = 4096, 8192

#: Cells with more home vectors than LARGE get pivots of their own: one for each PER_INNER of these, MOST_INNER at most.
LARGE, PER_INNER, MOST_INNER = 16384, 1024, 256

#: One in TRIAL rows of a large cell tells whether pivots would halve its comparisons.  It decides how a cell is joined, never what is joined.
TRIAL = 16

#: Distances are widened by this much, so that rounding never loses a pair; pairs are decided by their cosine.
SLACK = 1e-9


def unit_vectors(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector can link: not null, no null or non-finite component, not zero; ``unit`` has length 1, ``dim`` components.

    The largest component and the length are bound outside the functions that use them, so that they are
    computed once a vector and not once a component.
    """
    v = F.col(vec).cast("array<double>")
    fine = F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    bound = lambda x, use: F.get(F.transform(F.array(x), use), 0)
    scaled = bound(F.array_max(F.transform(v, F.abs)), lambda top: F.transform(v, lambda x: x / top))
    unit = bound(scaled, lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x * x, lambda n: F.transform(s, lambda x: x / F.sqrt(n))))
    return df.where(fine).withColumns({"unit": unit, "dim": F.size(vec)})


def choose_pivots(classes: DataFrame) -> dict[tuple, np.ndarray]:
    """Pivot vectors of each group (label, dim) that is too large for one cell: a reproducible random choice.

    A pivot stands for at least PER_PIVOT vectors and for 1/MOST_PIVOTS of all, so the number of groups that get
    any, and of pivots in all, has a fixed bound.
    """
    total = classes.count()
    per = max(PER_PIVOT, math.ceil(total / MOST_PIVOTS))
    want = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per).withColumn("p", F.ceil(F.col("n") / per))
    part = F.pmod(F.xxhash64(F.lit("pivot"), "key"), F.lit(1 << 30)) / float(1 << 30)
    found = classes.join(want, ["label", "dim"]).where(part < F.col("p") / F.col("n")).select("label", "dim", "key", "unit").collect()
    groups: dict[tuple, list] = {}
    for r in sorted(found, key=lambda r: r["key"]):
        groups.setdefault((r["label"], r["dim"]), []).append(r["unit"])
    return {k: np.array(v) for k, v in groups.items()}


def vectors(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(-1, dim)


def reach(x: np.ndarray, p: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector, and a mask of the pivots whose home vectors can be within ``eps`` of it, its own included.

    A vector v nearest to j can have a neighbour u at home in i within ``eps`` only if d(v, i) - d(v, j) <= 2 eps:
    d(v, i) <= d(v, u) + d(u, i) <= eps + d(u, j) <= 2 eps + d(v, j).  Euclidean distances also tell how far
    v is from the plane between i and j, beyond which u lies.
    """
    d = np.sqrt(np.maximum(2 - 2 * x @ p.T, 0))
    own = d.argmin(1)
    near = d[np.arange(len(x)), own][:, None]
    gaps = np.sqrt(np.maximum(2 - 2 * p[own] @ p.T, 0))
    return own, (d - near <= 2 * eps + SLACK) & ((d**2 - near**2) <= 2 * gaps * eps + SLACK)


def runs(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of a sorted batch that are equal in the named columns."""
    group = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
    cuts = [0, *(i for i in range(1, len(group)) if group[i] != group[i - 1]), len(group)]
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        if s < e:
            yield group[s], batch.slice(s, e - s)


def _cells(shared, eps: float):
    """Home cell of each vector, its nearest pivot, and the cells of smaller number in which it must be a guest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            label, dim = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
            rows: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(label, dim, strict=True)):
                rows.setdefault(k, []).append(i)
            take, cell, home = [], [], []
            for k, mine in rows.items():
                at = np.array(mine)
                if k not in pivots:
                    take.append(at), cell.append(np.zeros(len(at), int)), home.append(np.ones(len(at), bool))
                    continue
                p = pivots[k]
                for piece in np.array_split(at, max(1, len(at) * len(p) // 1_000_000)):
                    x = vectors(batch.column("unit").take(pa.array(piece)), k[1])
                    own, met = reach(x, p, eps)
                    r, c = np.nonzero(met & (np.arange(len(p))[None, :] < own[:, None]))
                    take += [piece, piece[r]]
                    cell += [own, c]
                    home += [np.ones(len(piece), bool), np.zeros(len(r), bool)]
            if take:
                at = np.concatenate(take)
                out = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(cell), pa.int32()), pa.array(np.concatenate(home))], names=[*out.schema.names, "cell", "home"])

    return run


def _inner(eps: float, fields: list[str]):
    """Rows of large cells dealt to the cells of inner pivots.  Rows come sorted by cell, share and role, the cell's pivots (role 0) before its rows in the share (role 1).

    A home vector is at home with its nearest pivot and a guest with those of smaller number, as in ``_cells``; a guest of the cell is
    a guest wherever home vectors can be near it.  So each pair still meets in one cell, with one of the two at home there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, p = None, None
        for batch in batches:
            for (*g, role), part in runs(batch, ["label", "dim", "cell", "s", "role"]):
                if g != held:
                    held, p = g, np.zeros((0, g[1]))
                x = vectors(part.column("unit"), g[1])
                if role == 0:
                    p = np.vstack([p, x])
                    continue
                at_home = part.column("home").to_numpy(zero_copy_only=False)
                step = max(1, 1_000_000 // max(1, len(p)))
                for a in range(0, len(x), step):
                    home = at_home[a : a + step]
                    own, met = reach(x[a : a + step], p, eps) if len(p) else (np.zeros(len(home), int), np.ones((len(home), 1), bool))
                    at = np.arange(met.shape[1])[None, :]
                    r, c = np.nonzero(met & (~home[:, None] | (at <= own[:, None])))
                    out = part.slice(a, step).select(fields).take(pa.array(r))
                    cell = [f"{g[2]}/{i}" for i in c]
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(home[r] & (c == own[r])), pa.array(cell, pa.string())], names=[*fields, "home", "inner"])

    return run


def sized(cells: DataFrame) -> DataFrame:
    """Cells that are someone's home, with their home vectors (nh) and all their rows (nc); settled."""
    return settle(cells.groupBy("label", "dim", "cell").agg(F.count_if("home").alias("nh"), F.count(F.lit(1)).alias("nc")).where("nh > 0"), "sizes")


def nested(cells: DataFrame, eps: float) -> tuple[DataFrame, DataFrame]:
    """Cells, and their sizes, after large cells were cut by pivots of their own, as often as that at least halves the comparisons of a cell.

    The pivots of a cell come to each of its shares by shuffle, so their number over all cells needs no bound and a task holds MOST_INNER.  Where
    distances concentrate, a trial on one in TRIAL rows says that pivots would not help, and the cell stays as it is.
    """
    group = ["label", "dim", "cell"]
    sizes = sized(cells)
    fresh, turn = sizes.where(F.col("nh") > LARGE), 0
    part = F.pmod(F.xxhash64(F.lit("inner"), "key"), F.lit(1 << 30)) / float(1 << 30)
    while not fresh.isEmpty():
        turn += 1
        if turn == 1:
            cells = settle(cells, "cells")
        big = settle(fresh.select(*group, "nh", F.least(F.lit(MOST_INNER), F.ceil(F.col("nh") / PER_INNER)).alias("k"), F.ceil(F.col("nc") / (STREAM * BLOCK)).cast("int").alias("ns")), "large")

        def dealt(rows: DataFrame, some: DataFrame, fields: list[str], turn: int = turn) -> DataFrame:
            plain = [*group, "key", "unit", "m", "home"]
            chance = F.pmod(F.xxhash64(F.lit(turn), "key"), F.lit(1 << 30)) / float(1 << 30)
            pivots = cells.where("home").join(some, group).where(chance < F.col("k") / F.col("nh"))
            first = pivots.select(*plain, F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("s"), F.lit(0).alias("role"))
            rest = rows.join(some, group).select(*plain, F.pmod(F.xxhash64("key", F.lit(2)), F.col("ns")).cast("int").alias("s"), F.lit(1).alias("role"))
            kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
            schema = ", ".join(f"`{c}` {kinds[c]}" for c in fields) + ", home boolean, inner string"
            keyed = first.unionByName(rest).repartition(*group, "s").sortWithinPartitions(*group, "s", "role", "key")
            return keyed.mapInArrow(_inner(eps, fields), schema)

        tried = dealt(cells.where(part < 1 / TRIAL), big, group).groupBy(*group, "inner").agg(F.count_if("home").alias("h"), F.count(F.lit(1)).alias("c"))
        before = cells.where(part < 1 / TRIAL).join(big, group).groupBy(*group).agg(F.count_if("home").alias("h0"), F.count(F.lit(1)).alias("c0"))
        after = tried.groupBy(*group).agg(F.sum(F.col("h") * F.col("c")).alias("work"))
        worth = settle(big.join(before.join(after, group).where("2 * work <= h0 * c0").select(*group), group), "worth")
        discard(big)
        if worth.isEmpty():
            break
        whole = [c for c in cells.columns if c not in ("home", "cell")]
        opened = settle(dealt(cells, worth, [*whole, "cell"]).select(*whole, F.col("inner").alias("cell"), "home"), "inner")
        grown = sized(opened)
        cells = cells.join(worth.select(*group), group, "left_anti").select(*whole, "cell", "home").unionByName(opened)
        sizes = sizes.join(worth.select(*group), group, "left_anti").unionByName(grown)
        fresh = grown.where(F.col("nh") > LARGE)
    return cells, sizes


def _joined(least: float):
    """Links within cells.  Rows come sorted by cell, block and share, the block's own homes (role 0) before the cell's rows in the share (role 1).

    Emits for each block and share: key, links of every home (to homes and guests) and of guests to it, and edges that
    connect what is linked: each linked row to one home, each home to the root of those it shares a row with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"group": None}

        def out(keys, links, others):
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(links, pa.int64()), pa.array(others, pa.string())], names=["key", "links", "other"])

        def root(i):
            up = state["up"]
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        def closed():
            if state["group"] is not None and state["keys"]:
                keys = state["keys"]
                yield out(keys, state["links"], [keys[root(i)] for i in range(len(keys))])

        for batch in batches:
            for (*g, role), part in runs(batch, ["label", "dim", "cell", "b", "s", "role"]):
                if g != state["group"]:
                    yield from closed()
                    state = {"group": g, "keys": [], "m": np.zeros(0, np.int64), "x": np.zeros((0, g[1])), "links": np.zeros(0, np.int64), "up": []}
                x, keys, m = vectors(part.column("unit"), g[1]), part.column("key").to_pylist(), part.column("m").to_numpy()
                if role == 0:
                    state["up"] += range(len(state["keys"]), len(state["keys"]) + len(keys))
                    state["keys"] += keys
                    state["m"], state["x"], state["links"] = np.r_[state["m"], m], np.vstack([state["x"], x]), np.r_[state["links"], np.zeros(len(m), np.int64)]
                    state["top"] = np.array(state["up"])
                    state["place"] = {k: i for i, k in enumerate(state["keys"])}
                    continue
                if not state["keys"]:
                    continue
                home = part.column("home").to_numpy(zero_copy_only=False)
                for a in range(0, len(x), 512):
                    near = x[a : a + 512] @ state["x"].T >= least
                    for i, k in enumerate(keys[a : a + 512]):
                        if k in state["place"]:
                            near[i, state["place"][k]] = False
                    state["links"] += m[a : a + 512] @ near
                    any_ = np.flatnonzero(near.any(1))
                    if not len(any_):
                        continue
                    first = near[any_].argmax(1)
                    yield out([keys[a + i] for i in any_], np.where(home[a + any_], 0, near[any_] @ state["m"]), [state["keys"][f] for f in first])
                    for i, f in zip(any_, first, strict=True):
                        r = root(f)
                        fresh = np.flatnonzero(near[i] & (state["top"] != state["top"][f]))
                        for j in fresh:
                            state["up"][root(j)] = r
                        if len(fresh):
                            state["top"] = np.array([root(j) for j in range(len(state["up"]))])
        yield from closed()

    return run


def near_vectors(df: DataFrame, least: float = 0.93, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """Add n_links, component_id and kept to every row; vectors link if their labels are equal and their cosine is ``least`` or more.

    Cosines are taken in double precision.  Null labels, vectors that are null or zero, hold null or non-finite
    components, or have different lengths link with nothing; such a row is its own component.  Rows with the same
    label and vector are one class of copies: they link with each other and share all other links, so a
    class is compared once.  Repeated rows link with each other too.  component_id is the smallest id that links
    reach, the row's own included.  A column named like an added one is replaced.

    Pivots cut each large label into cells; the triangle inequality says which vectors must be guests in other
    cells; cells that are still large are cut again by pivots of their own, where that saves comparisons; a cell joins in blocks of BLOCK home vectors, against each of which the cell streams in shares of STREAM times that many
    rows, so that rows and memory of a task are bounded whatever the cell holds.  Where distances concentrate (many dimensions, no clusters) most vectors
    are guests everywhere and the work is quadratic in a label: exactness leaves no other way.  A worker holds the pivots, BLOCK home vectors and a
    million distances at a time; the cost of a vector is linear in its length.
    """
    base = without(df, ["n_links", "component_id", "kept"])
    eps = math.sqrt(max(0.0, 2 - 2 * least)) + SLACK
    spark = df.sparkSession
    fit = F.md5(F.concat_ws("|", F.col(label).cast("string"), F.col(vec).cast("string")))
    keyed = unit_vectors(base.where(F.col(label).isNotNull()).select(F.col(vec_id).alias("id"), F.col(label).alias("label"), vec), vec).withColumn("key", fit)
    classes = settle(keyed.groupBy("key").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("unit").alias("unit"), F.count(F.lit(1)).alias("m"), F.min("id").alias("id")), "vectors")
    shared = spark.sparkContext.broadcast(choose_pivots(classes))
    fields = classes.select("key", "label", "dim", "unit", "m")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.schema) + ", cell int, home boolean"
    group = ["label", "dim", "cell"]
    cells, counts = nested(fields.mapInArrow(_cells(shared, eps), schema).withColumn("cell", F.col("cell").cast("string")), eps)
    sizes = counts.select(*group, F.ceil(F.col("nh") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("nc") / (STREAM * BLOCK)).cast("int").alias("ns"))
    own, share = F.pmod(F.xxhash64("key"), F.col("nb")).cast("int"), F.pmod(F.xxhash64("key", F.lit(1)), F.col("ns")).cast("int")
    dealing = lambda role, b, s: F.struct(F.lit(role).alias("role"), b.alias("b"), s.alias("s"))
    held = F.transform(F.sequence(F.lit(0), F.col("ns") - 1), lambda s: dealing(0, own, s))
    streamed = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda b: dealing(1, b, share))
    spread = cells.join(sizes, group).withColumn("__d", F.explode(F.concat(F.when(F.col("home"), held).otherwise(F.slice(held, 1, 0)), streamed)))
    rows = spread.select("key", *group, "unit", "m", "home", "__d.b", "__d.s", "__d.role")
    dealt = rows.repartition(*group, "b", "s").sortWithinPartitions(*group, "b", "s", "role")
    found = settle(dealt.mapInArrow(_joined(least), "key string, links bigint, other string"), "links")
    discard(counts)
    links = settle(found.groupBy("key").agg(F.sum("links").alias("links")), "link_counts")
    name = classes.select("key", "m", F.struct(F.col("id").isNull().alias("none"), "id", "key").alias("node"))
    ends = found.where("key <> other").select("key", "other").join(name.select("key", F.col("node").alias("a")), "key").join(name.select(F.col("key").alias("other"), F.col("node").alias("b")), "other").select("a", "b")
    comps = components(ends)
    discard(found)
    info = name.join(links, "key", "left").join(comps, "node", "left")
    info = info.select("key", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("root", "node")["id"].alias("component_id"))
    out = base.withColumn("__key", fit).join(info, F.col("__key") == F.col("key"), "left")
    cid = F.coalesce("component_id", F.col(vec_id))
    return out.select(*[F.col(f"`{c}`") for c in base.columns], F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), cid.eqNullSafe(F.col(vec_id)).alias("kept"))


def op6_metric_join(spark, sf_dir: str) -> DataFrame:
    vecs = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return near_vectors(vecs).select("vec_id", "n_links", "component_id", "kept")


SQL = r"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(v, v) > 0),
p AS (SELECT a.r, a.vec_id AS a_id, b.r AS s, b.vec_id AS b_id FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
c AS (SELECT r, vec_id AS m FROM e UNION SELECT p.s, c.m FROM c JOIN p ON p.r = c.r),
n AS (SELECT r, count(*) AS n FROM p GROUP BY r)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, (SELECT min(m) FROM c WHERE c.r = e.r) AS component_id, e.vec_id = (SELECT min(m) FROM c WHERE c.r = e.r) AS kept FROM e LEFT JOIN n USING (r)
"""
