"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes, calibrated out of fold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heirloom.llm.common import appended, chunks, crc_text, settle, span_hashes, with_columns, without, word_spans
from heirloom.llm.quality import training_rows

#: The sample that the classifier is fitted on: labelled documents, at most, those with the smallest hashes of their ids, and terms of them all
#: together, at most (a document beyond is left out of the sample whole, never cut).
MOST_EXAMPLES, MOST_POSTINGS = 8_000, 8_000_000

#: Bytes of a word's beginning that is a term beside the word.
BEGINNING = 5

#: Neighbours that vote; examples in a block of the index; texts that are scored together.
NEIGHBOURS, BLOCK, TOGETHER = 10, 64, 32

#: Terms that more than one in COMMON_SHARE examples have are bounded by block before they are summed; least distance that a vote is divided by.
COMMON_SHARE, CLOSEST = 24, 1e-4

#: Documents of the other label that count beside those seen in a term's relevance; its power.
DOUBT, POWER = 5.0, 2

#: Folds of the calibration, and points of the line "the share is the vote" that it starts from.
FOLDS, LINE = 5, 11

#: A cosine of 1 in 20 bits, and the largest place that is carried below it.
ONE, FULL = float(1 << 20), (1 << 24) - 1

#: What sets a beginning apart from the word that equals it.
TAG = np.uint64(0x5851F42D4C957F2D)


def _letter_codes() -> np.ndarray:
    """Of each byte: 0 outside words, else itself with A-Z lower-cased; words hold letters and all beyond ASCII."""
    code = np.zeros(256, np.uint8)
    code[0x61:0x7B], code[0x41:0x5B] = np.arange(0x61, 0x7B), np.arange(0x61, 0x7B)
    code[0x80:] = np.arange(0x80, 0x100)
    return code


CODES = _letter_codes()


class Counts:
    """Terms of some texts: ``terms``, the distinct hashes, and of every text and term of it ``text`` (ascending), ``term`` (its place there) and ``n``."""

    def __init__(self, texts: int, terms: np.ndarray, text: np.ndarray, term: np.ndarray, n: np.ndarray):
        self.texts, self.terms, self.text, self.term, self.n = texts, terms, text, term, n

    @classmethod
    def read(cls, data: np.ndarray, offsets: np.ndarray) -> Counts:
        """All words of each text, and the first BEGINNING bytes of those that are as long."""
        low, starts, ends, bounds = word_spans(data, offsets, CODES)
        words, first, place = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
        long = np.flatnonzero(ends[first] - starts[first] >= BEGINNING)
        begun, of = np.unique(span_hashes(low, starts[first[long]], starts[first[long]] + BEGINNING) ^ TAG, return_inverse=True)
        begin = np.full(len(words), -1)
        begin[long] = len(words) + of
        owner, also = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), begin[place]
        terms = np.concatenate([words, begun])
        many = max(1, len(terms))
        pair, n = np.unique(np.concatenate([owner * many + place, (owner * many + also)[also >= 0]]), return_counts=True)
        return cls(len(offsets) - 1, terms, pair // many, pair % many, n)


def _packed(v: np.ndarray) -> tuple[str, int, bytes]:
    v = v.astype(np.uint16 if v.max(initial=0) < 1 << 16 else np.uint32)
    return v.dtype.str, v.nbytes, pa.compress(v.tobytes(), "zstd", asbytes=True)


def _unpacked(kept: tuple[str, int, bytes]) -> np.ndarray:
    kind, size, raw = kept
    return np.frombuffer(pa.decompress(raw, size, "zstd", asbytes=True), kind)


class ExampleIndex:
    """Postings of all terms of all examples in blocks of like examples.

    A vector holds (1 + log tf) idf rf of every term of its whole text; idf is log((1 + n) / (1 + df)) + 1 over the n examples,
    rf the relevance frequency log2(2 + r) squared, r being how many times as often examples of label 1 have the term as others.
    Terms are words of letters, so digits and signs give none; no other is left out.  A text without terms scores the share of label 1 among examples
    without terms, and 0 if there are none: nothing speaks for it.  A term that no example has still counts in a text's length.

    Terms of few examples are lists of examples and weights, and what they add is summed for every example.  Of the other
    terms each block keeps its examples' weights and the largest of them: a text's weights times those maxima, plus
    the largest sum of the rarer terms in the block, bound all cosines in it, and a block is summed only for texts whose bound
    reaches their k-th best so far.  So neighbours are exact.
    """

    held: ExampleIndex | None = None

    def __init__(self, ids: list, y: np.ndarray, rows: np.ndarray, hashes: np.ndarray, tf: np.ndarray, k: int = NEIGHBOURS, block: int = BLOCK):
        """Of every term of every example ``rows``, the example's place (ascending), its hash and its count."""
        self.ids, self.y, self.k, self.block, self.lists = ids, np.asarray(y, float), k, block, None
        self.n, yes = len(self.y), self.y.sum()
        order = np.argsort(hashes, kind="stable")
        self.posted = _packed(rows[order]), _packed(tf[order])
        hashes = hashes[order]
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, int)
        self.terms, self.df = hashes[first], np.diff(np.r_[first, len(hashes)]).astype(np.int32)
        self.rate = float((yes + 0.5) / (self.n + 1))
        bare = np.bincount(rows, minlength=self.n) == 0
        self.bare_rate = float((self.y[bare].sum() + self.rate / 2) / (bare.sum() + 0.5)) if bare.any() else 0.0
        self.knots = np.linspace(0, 1, LINE), np.linspace(0, 1, LINE)

    def __getstate__(self):
        """What weights follow from: ids and counts, compressed, as every executor keeps a copy on its disk."""
        return {k: self.__dict__[k] for k in ("ids", "y", "k", "block", "n", "terms", "df", "posted", "rate", "bare_rate", "knots")} | {"lists": None}

    def postings(self) -> tuple[np.ndarray, np.ndarray]:
        """Example and count of all postings, by term."""
        return _unpacked(self.posted[0]), _unpacked(self.posted[1])

    def size(self) -> int:
        """Bytes that are sent to each executor."""
        return self.terms.nbytes + self.df.nbytes + sum(len(p[2]) for p in self.posted) + 64 * self.n

    def release(self) -> None:
        self.lists = self.weights = self.dense = self.top = None
        ExampleIndex.held = None

    def weigh(self) -> None:
        """Weights and blocks; done where they are used.  Of the indexes of a process only the last one used holds them."""
        if ExampleIndex.held is not None:
            ExampleIndex.held.release()
        ExampleIndex.held = self
        n, df, yes = self.n, self.df, self.y.sum()
        rows, tf = self.postings()
        place = np.repeat(np.arange(len(df), dtype=np.int32), df)
        seen = np.bincount(place[(self.y > 0)[rows]], minlength=len(df))
        relevance = (seen / max(yes, 1)) / ((df - seen + DOUBT) / max(n - yes, 1))
        self.idf = ((np.log((1 + n) / (1 + df)) + 1) * np.log2(2 + relevance) ** POWER).astype(np.float32)
        self.new = float(np.log(1 + n) + 1)
        del seen, relevance
        w, norm = np.empty(len(rows), np.float32), np.zeros(n)
        for at in range(0, len(w), 1 << 18):
            part = slice(at, at + (1 << 18))
            w[part] = (1 + np.log(tf[part], dtype=np.float32)) * self.idf[place[part]]
            norm += np.bincount(rows[part], w[part] * w[part], minlength=n)
        del tf
        norm = np.sqrt(norm).astype(np.float32)
        for at in range(0, len(w), 1 << 18):
            part = slice(at, at + (1 << 18))
            w[part] /= norm[rows[part]]
        many = df.astype(int) * COMMON_SHARE > n
        common = many[place]
        self.column = np.where(many, np.cumsum(many) - 1, -1).astype(np.int32)
        at, col, value = rows[common], self.column[place[common]], w[common]
        del place
        heavy = np.lexsort((-value, at))
        first = heavy[np.flatnonzero(np.r_[True, np.diff(at[heavy]) != 0])] if len(at) else heavy
        alike = np.full(n, -1)
        alike[at[first]] = col[first]  # examples with the same heaviest common term share blocks
        del heavy, first
        self.order = np.argsort(alike, kind="stable")
        new_place = np.empty(n, np.int32)
        new_place[self.order] = np.arange(n)
        self.dense = np.zeros((n, max(1, int(many.sum()))), np.float32)
        self.dense[new_place[at], col] = value
        self.lists, self.weights = new_place[rows[~common]], w[~common]
        self.start = np.r_[0, np.cumsum(np.where(many, 0, df))]
        self.cuts = np.arange(0, n, self.block)
        self.top = np.maximum.reduceat(self.dense, self.cuts, axis=0)

    def nearest(self, counts: Counts) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k nearest of each text, the nearest first; ties by place in the index, cosine 0 where there is none."""
        k = min(self.k, self.n)
        found, sims = np.zeros((counts.texts, self.k), np.int64), np.zeros((counts.texts, self.k))
        if not self.n or not len(self.terms) or not len(counts.terms):
            return found, sims
        if self.lists is None:
            self.weigh()
        at = np.minimum(np.searchsorted(self.terms, counts.terms), len(self.terms) - 1)
        known = self.terms[at] == counts.terms
        w = (1 + np.log(counts.n)) * np.where(known, self.idf[at], self.new)[counts.term]
        w /= np.sqrt(np.bincount(counts.text, w * w, minlength=counts.texts))[counts.text]
        hit = known[counts.term]
        text, term, w = counts.text[hit], at[counts.term[hit]], w[hit].astype(np.float32)
        bounds = np.searchsorted(text, np.arange(counts.texts + 1))
        for lo in range(0, counts.texts, TOGETHER):
            hi = min(lo + TOGETHER, counts.texts)
            part = slice(bounds[lo], bounds[hi])
            best = self._best(hi - lo, text[part] - lo, term[part], w[part], k)
            found[lo:hi, :k], sims[lo:hi, :k] = self.order[FULL - (best & FULL)], (best >> 24) / ONE
        return found, sims

    def _best(self, m: int, text: np.ndarray, term: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
        """For each of m texts the k largest cosines, each carried in one number with the example's place, so that equal ones fall alike in any company."""
        n, column = self.n, self.column[term]
        thick = column >= 0
        q = np.zeros((m, self.dense.shape[1]), np.float32)
        q[text[thick], column[thick]] = w[thick]
        text, term, w = text[~thick], term[~thick], w[~thick]
        size = self.start[term + 1] - self.start[term]
        index = np.repeat((self.start[term] - np.r_[0, np.cumsum(size)[:-1]]).astype(np.int32), size) if len(size) else np.zeros(0, np.int32)
        index += np.arange(len(index), dtype=np.int32)
        value = self.weights[index]
        value *= np.repeat(w, size)
        index = self.lists[index]
        index += np.repeat((text * n).astype(np.int32), size)
        rare = np.bincount(index, value, minlength=m * n).astype(np.float32).reshape(m, n)
        del index, value
        bound = q @ self.top.T + np.maximum.reduceat(rare, self.cuts, axis=1)
        sums = np.zeros((m, n), np.float32)
        least, done, step = np.zeros(m, np.float32), np.zeros(0, np.int64), 4
        order = np.argsort(-bound.sum(0), kind="stable")
        at = 0
        while at < len(order):
            now = order[at : at + step]
            for b in now:
                go = np.flatnonzero(bound[:, b] >= least - 1e-5)
                if len(go):
                    a, z = self.cuts[b], min(self.cuts[b] + self.block, n)
                    sums[go, a:z] = q[go] @ self.dense[a:z].T + rare[go, a:z]
            at, step = at + step, 2 * step
            done = np.concatenate([done, *(np.arange(self.cuts[b], min(self.cuts[b] + self.block, n)) for b in now)])
            if at < len(order) and len(done) > k:
                least = np.maximum(least, np.partition(sums[:, done], len(done) - k, axis=1)[:, len(done) - k])
        bits = np.rint(np.clip(sums, 0, 1) * ONE).astype(np.int64)
        packed = np.where(bits > 0, (bits << 24) | (FULL - np.arange(n)), FULL)
        packed.partition(n - k, axis=1)
        top = packed[:, n - k :]
        top.sort(axis=1)
        return top[:, ::-1]

    def votes(self, found: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Share of label 1 among the neighbours, each with weight cosine / distance; nan without any."""
        w = sims / np.maximum(1 - sims, CLOSEST)
        mass = w.sum(1)
        return np.divide((w * self.y[found]).sum(1), mass, out=np.full(len(mass), np.nan), where=mass > 0) if self.n else np.full(len(found), np.nan)

    def score(self, votes: np.ndarray) -> np.ndarray:
        """Votes to calibrated shares; a text without neighbours gets the share of label 1 among examples without terms."""
        return np.where(np.isnan(votes), self.bare_rate, np.interp(np.nan_to_num(votes), *self.knots))

    def fold(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Examples of a fold, and their votes by an index, weights included, of all the others."""
        own = np.arange(self.n) % FOLDS == f
        number = np.empty(self.n, np.int32)
        number[own], number[~own] = np.arange(own.sum()), np.arange((~own).sum())

        def part(chosen):
            """Example, term and count of the chosen examples' postings."""
            rows, tf = self.postings()
            mine = np.flatnonzero(chosen[rows]).astype(np.int32)
            term = np.repeat(np.arange(len(self.df), dtype=np.int32), self.df)[mine]
            at = number[rows[mine]]
            by = np.argsort(at, kind="stable")
            return at[by], term[by], tf[mine[by]]

        at, term, tf = part(~own)
        rest = ExampleIndex([], self.y[~own], at, self.terms[term], tf, self.k, self.block)
        del at, term, tf
        at, term, tf = part(own)
        votes = rest.votes(*rest.nearest(Counts(int(own.sum()), self.terms, at, term, tf)))
        rest.release()
        return np.flatnonzero(own), votes


def isotonic(votes: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising line that turns votes into shares of label 1: pools of neighbours that would fall, with LINE points of the diagonal as a start."""
    line = np.linspace(0, 1, LINE)
    x, y = np.r_[line, votes], np.r_[line, y]
    order = np.lexsort((-y, x))  # of equal votes label 1 comes first, so they share a pool
    pools: list[list[float]] = []  # weight, sum of y, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([1.0, b, a])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0] - 1e-9:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last, strict=True)]
    n, yes, at = np.array(pools).T
    return at / n, yes / n


def calibrated(spark, index: ExampleIndex) -> ExampleIndex:
    """The index with knots from the votes that each example gets from those of other folds; folds are tasks."""
    if index.n < 2 * FOLDS or index.y.min() == index.y.max():
        return index
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.column(0).to_pylist():
                at, votes = shared.value.fold(f)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(votes)], names=["place", "vote"])

    rows = spark.range(0, FOLDS, 1, FOLDS).mapInArrow(run, "place bigint, vote double").toArrow()
    shared.unpersist()
    at, votes = rows.column("place").to_numpy(), rows.column("vote").to_numpy()
    order = np.argsort(at)
    at, votes = at[order], votes[order]
    seen = ~np.isnan(votes)
    index.knots = isotonic(votes[seen], index.y[at[seen]])
    return index


def build_index(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", most: int = MOST_EXAMPLES, postings: int = MOST_POSTINGS, k: int = NEIGHBOURS) -> ExampleIndex:
    """Calibrated index of at most ``most`` labelled examples with at most ``postings`` terms; of rows with one key the smallest text stands."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    few = spark.createDataFrame(training_rows(docs, labels, label, key, most).collect(), f"`{key}` {kind}, y int")
    chosen = docs.select(key, text).join(F.broadcast(few), key).groupBy(F.col(key).alias("k")).agg(F.first("y").alias("y"), F.min(text).alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches):
            c = Counts.read(data, offsets)
            ends = np.searchsorted(c.text, np.arange(batch.num_rows + 1))
            packed = lambda v, ends=ends: pa.array([v[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), pa.array(np.diff(ends), pa.int64()), packed(c.terms[c.term]), packed(c.n.astype(np.uint32))], names=["k", "y", "n", "terms", "tf"])

    rows = settle(chosen.mapInArrow(vectors, f"k {kind}, y int, n bigint, terms binary, tf binary"), "examples")
    sizes = rows.select("k", "n").orderBy(F.xxhash64("k"), "k").collect()
    fits = np.cumsum([r["n"] for r in sizes]) <= postings
    if not all(fits):
        rows = rows.join(F.broadcast(spark.createDataFrame([(r["k"],) for r, fit in zip(sizes, fits, strict=True) if fit], f"k {kind}")), "k", "left_semi")
    found = rows.orderBy(F.xxhash64("k"), "k").toArrow()
    ids, y = found.column("k").to_pylist(), found.column("y").to_numpy()
    owner = np.repeat(np.arange(found.num_rows, dtype=np.int32), found.column("n").to_numpy())
    hashes, tf = (np.concatenate([np.frombuffer(x, t) for x in found.column(c).to_pylist()] or [np.zeros(0, t)]) for c, t in (("terms", np.uint64), ("tf", np.uint32)))
    del found
    return calibrated(spark, ExampleIndex(ids, y, owner, hashes, tf, k))


def score_toxicity(docs: DataFrame, index: ExampleIndex, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add score, predicted (1 if score >= threshold) and evidence (``id:label:cosine`` of the five nearest examples) to every row.

    A text's nearest examples vote with weights cosine / distance, and the votes' share is calibrated on the examples out of fold, so a score
    is the share of label 1 to be expected.  A text without terms of the examples, null and empty ones too, scores the share of label 1 among
    examples without terms, and 0 if there are none: then nothing speaks for it.  Without examples nothing is known to be toxic: every score is 0.  Texts of any length are read whole.
    Equally near examples count in the index's order.  Rows may repeat; no row gives no row.  A column named like an added one is replaced.
    """
    base = without(docs, ["score", "predicted", "evidence"])
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, data, offsets in chunks(batches, text):
            at, sims = own.nearest(Counts.read(data, offsets))
            s = own.score(own.votes(at, sims))
            why = [[f"{own.ids[x]}:{int(own.y[x])}:{c:.4f}" for x, c in zip(a, v, strict=True) if c > 0] for a, v in zip(at[:, :5].tolist(), sims[:, :5].tolist(), strict=True)]
            yield with_columns(batch, score=pa.array(s, pa.float64()), predicted=pa.array((s >= threshold).astype(np.int32)), evidence=pa.array(why, pa.list_(pa.string())))

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(T.StringType()))]
    return base.mapInArrow(run, appended(base.schema, fields))


def op2_nearest_toxic(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = crc_text("doc_id") % 4 == 2
    index = build_index(docs, labels.where(~held_out))
    return score_toxicity(docs, index).select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")
