"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees, boosted feature by feature in turn, add up to one lookup table for each feature; then trees over
the strongest pairs of features add one table for each pair.  A score is a sum of table entries.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heirloom.llm.common import appended, chunks, crc_text, with_columns, without, words

#: Labelled rows that the model is fitted on, at most: those with the smallest hashes of their ids.
MOST_TRAINING_ROWS = 20_000

FEATURES = ["log_bytes", "log_words", "word_length", "upper", "digit", "space", "newline", "stop", "comma", "symbol", "bar", "bang", "beyond_ascii", "distinct_words", "top_word", "deflated", "capital_words", "line_length"]


def _classes() -> np.ndarray:
    """Of each byte: the column of the counts that it belongs to."""
    kind = np.full(256, 8, np.uint8)  # symbols
    kind[0x41:0x5B], kind[0x61:0x7B], kind[0x30:0x3A], kind[0x80:] = 0, 1, 2, 3
    kind[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], kind[0x0A] = 4, 5
    kind[[ord("."), ord("?")]], kind[[ord(","), ord(";"), ord(":"), ord("'"), ord('"'), ord("-"), ord("("), ord(")")]] = 6, 7
    kind[ord("|")], kind[ord("!")] = 9, 10
    return kind


KIND = _classes()


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text, from all its bytes and words."""
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    count = np.bincount(owner * 11 + KIND[data], minlength=rows * 11).reshape(rows, 11).astype(float)
    hashes, starts, bounds = words(data, offsets)
    n = np.diff(bounds).astype(float)
    doc = np.repeat(np.arange(rows), np.diff(bounds))
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(fresh)
    runs = np.diff(np.r_[at, len(h)])
    distinct = np.bincount(d[at], minlength=rows).astype(float)
    top = np.zeros(rows)
    np.maximum.at(top, d[at], runs)
    capital = np.bincount(doc, weights=(KIND[data[starts]] == 0) if len(starts) else None, minlength=rows) if len(doc) else np.zeros(rows)
    deflated = np.array([len(zlib.compress(data[offsets[i] : offsets[i + 1]], 1)) for i in range(rows)], float)
    one, some = np.maximum(size, 1), np.maximum(n, 1)
    letters = count[:, 0] + count[:, 1] + count[:, 3]
    cols = [
        np.log1p(size), np.log1p(n), letters / some, count[:, 0] / one, count[:, 2] / one, count[:, 4] / one, count[:, 5] / some, count[:, 6] / some, count[:, 7] / some,
        count[:, 8] / some, count[:, 9] / some, count[:, 10] / some, count[:, 3] / one, distinct / some, top / some, deflated / one, capital / some, n / (count[:, 5] + 1),
    ]
    return np.stack(cols, axis=1)


@dataclass
class AdditiveModel:
    """Tables by bin: one for each feature, one for each chosen pair.  The logit is their sum plus ``base``."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], "right")]
        for a, b, t in self.pairs:
            z += t[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """Leaf values, spread over the bins, of the tree that splits the ordered bins into at most ``leaves`` runs, best first."""
    gs, hs = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    gain = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + l2)
    cuts = [0, len(g)]
    while len(cuts) - 1 < leaves:
        best = (1e-9, None)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                mid = np.arange(a + 1, b)
                gains = gain(a, mid) + gain(mid, b) - gain(a, b)
                k = int(gains.argmax())
                best = max(best, (float(gains[k]), int(mid[k])), key=lambda t: t[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + l2)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """Values of the four-leaf tree that splits a grid by one cut of each feature, and its gain."""
    cell = lambda m: np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0)))[1:, 1:]
    cg, ch = cell(g), cell(h)
    tg, th = cg[-1, -1], ch[-1, -1]
    ag, ah = cg[:-1, :-1], ch[:-1, :-1]
    bg, bh = cg[:-1, -1:] - ag, ch[:-1, -1:] - ah
    dg, dh = cg[-1:, :-1] - ag, ch[-1:, :-1] - ah
    eg, eh = tg - ag - bg - dg, th - ah - bh - dh
    gain = sum(x**2 / (y + l2) for x, y in ((ag, ah), (bg, bh), (dg, dh), (eg, eh))) - tg**2 / (th + l2)
    if not gain.size:
        return np.zeros_like(g), 0.0
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros_like(g)
    for rows, cols, x, y in ((slice(0, i + 1), slice(0, j + 1), ag, ah), (slice(0, i + 1), slice(j + 1, None), bg, bh), (slice(i + 1, None), slice(0, j + 1), dg, dh), (slice(i + 1, None), slice(j + 1, None), eg, eh)):
        out[rows, cols] = x[i, j] / (y[i, j] + l2)
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 48, leaves: int = 3, pairs: int = 8, pair_rounds: int = 40, grid: int = 8, l2: float = 1.0) -> AdditiveModel:
    """Cyclic boosting of the log loss; pairs are ranked by the gain of one tree on what the single tables leave."""
    model = AdditiveModel()
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model.base = float(np.log(share / (1 - share)))
    k = x.shape[1]
    model.edges = [_edges(x[:, j], bins) for j in range(k)]
    model.coarse = [_edges(x[:, j], grid) for j in range(k)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if len(y) < 2 or y.min() == y.max():
        return model
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    z = np.full(len(y), model.base)
    for _ in range(rounds):
        for j in range(k):
            p = 1 / (1 + np.exp(-z))
            n = len(model.tables[j])
            step = rate * _tree(np.bincount(at[j], y - p, n), np.bincount(at[j], p * (1 - p), n), leaves, l2)
            model.tables[j] += step
            z += step[at[j]]
    rough = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    wide = [len(e) + 1 for e in model.coarse]

    def sums(a, b, p):
        flat, shape = rough[a] * wide[b] + rough[b], (wide[a], wide[b])
        return np.bincount(flat, y - p, wide[a] * wide[b]).reshape(shape), np.bincount(flat, p * (1 - p), wide[a] * wide[b]).reshape(shape)

    p = 1 / (1 + np.exp(-z))
    ranked = sorted(((_grid_tree(*sums(a, b, p), l2)[1], a, b) for a in range(k) for b in range(a + 1, k)), reverse=True)[:pairs]
    found = [(a, b, np.zeros((wide[a], wide[b]))) for gain, a, b in ranked if gain > 1e-6]
    for _ in range(pair_rounds):
        for a, b, t in found:
            p = 1 / (1 + np.exp(-z))
            step = rate * _grid_tree(*sums(a, b, p), l2)[0]
            t += step
            z += step[rough[a], rough[b]]
    model.pairs = found
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """key and y (0 or 1) of at most ``most`` labelled documents, those with the smallest hashes of their keys.

    Labels of one key are averaged and rounded up; null keys and labels don't count.
    """
    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.avg(label).alias("y"))
    return one.select(key, (F.col("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64(key), key).limit(most)


def _measured(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, text):
            x = features(data, offsets)
            cols = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("__k"), batch.column("y"), cols], names=["k", "y", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", most: int = MOST_TRAINING_ROWS, **options) -> AdditiveModel:
    """Fit on the driver: at most ``most`` rows of a few numbers each.

    A document whose key repeats counts once, by the smallest of its rows' features, which is taken before rows reach the driver; rows of equal features are as one.
    """
    spark = docs.sparkSession
    few = spark.createDataFrame(training_rows(docs, labels, label, key, most).collect(), f"`{key}` {docs.schema[key].dataType.simpleString()}, y int")
    chosen = docs.select(key, text).join(F.broadcast(few), key).select(F.col(key).alias("__k"), "y", text)
    rows = chosen.mapInArrow(_measured(text), f"k {docs.schema[key].dataType.simpleString()}, y int, x array<double>").groupBy("k").agg(F.min(F.struct("x", "y")).alias("r"))
    first = sorted(rows.select("k", "r.x", "r.y").collect(), key=lambda r: r["k"])  # a row for each labelled key
    x = np.array([r["x"] for r in first]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["y"] for r in first], float), **options)


def score(docs: DataFrame, model: AdditiveModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold) to every row.

    Null texts count as empty, and empty texts are scored by the same tables.  Rows may repeat; no row gives no
    row.  A column named like an added one is replaced.
    """
    base = without(docs, ["score", "predicted"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, text):
            s = shared.value.score(features(data, offsets))
            yield with_columns(batch, score=pa.array(s), predicted=pa.array((s >= threshold).astype(np.int32)))

    return base.mapInArrow(run, appended(base.schema, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op1_additive_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held_out = crc_text("doc_id") % 5 == 0
    model = train(docs, labels.where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
