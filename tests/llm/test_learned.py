"""Classifiers by held-out accuracy and exact neighbours, and the pipeline's stages."""

import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heirloom.llm import quality, toxicity
from heirloom.llm.common import crc_text, table
from heirloom.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, size=(3000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(3000) < 0.02)).astype(float)
    m = quality.fit(x[:2000], y[:2000])
    assert (m.pairs[0][0], m.pairs[0][1]) == (0, 1)
    assert ((m.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.85
    alone = quality.fit(x[:5], np.ones(5))
    assert np.isfinite(alone.score(x)).all() and quality.fit(x[:0], np.zeros(0)).score(x[:1])[0] == 0.5


def test_trees_by_trying_all_cuts():
    """The tree of runs takes the best cut that there is, one after the other; the grid's tree the best pair of cuts."""
    rng = np.random.default_rng(7)
    for _ in range(60):
        n, l2 = int(rng.integers(1, 9)), 1.0
        g, h = rng.normal(size=n), rng.uniform(0, 2, n)
        worth = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + l2)  # noqa: B023, E731
        cuts = [0, n]
        for _ in range(2):
            every = [(worth(a, m) + worth(m, b) - worth(a, b), m) for a, b in zip(cuts, cuts[1:], strict=False) for m in range(a + 1, b)]
            if every and max(every)[0] > 1e-9:
                cuts = sorted([*cuts, max(every)[1]])
        want = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + l2)) for a, b in zip(cuts, cuts[1:], strict=False)])
        assert quality._tree(g, h, 3, l2) == pytest.approx(want)
        r, c = int(rng.integers(1, 6)), int(rng.integers(1, 6))
        g, h = rng.normal(size=(r, c)), rng.uniform(0, 2, (r, c))
        part = lambda i, j: [(slice(a, b), slice(x, y)) for a, b in ((0, i), (i, r)) for x, y in ((0, j), (j, c))]  # noqa: B023, E731
        gain = lambda i, j: sum(g[p].sum() ** 2 / (h[p].sum() + l2) for p in part(i, j)) - g.sum() ** 2 / (h.sum() + l2)  # noqa: B023, E731
        found = [(gain(i, j), i, j) for i in range(1, r) for j in range(1, c)]
        values, best = quality._grid_tree(g, h, l2)
        if not found:
            assert best == 0 and not values.any()
            continue
        assert best == pytest.approx(max(found)[0])
        for p in part(*max(found)[1:]):
            assert values[p] == pytest.approx(np.full(values[p].shape, g[p].sum() / (h[p].sum() + l2)))


def test_the_other_features_by_plain_counts():
    rng = random.Random(9)
    texts = ["", "Ab, c. D?", "é \t|x"] + ["".join(rng.choice("abCD é,.;:'\"-()?!|\n\t 9#€") for _ in range(rng.randrange(400))) for _ in range(60)]
    enc = [t.encode() for t in texts]
    x = quality.features(np.frombuffer(b"".join(enc), np.uint8), np.r_[0, np.cumsum([len(b) for b in enc])])
    for b, row in zip(enc, x, strict=True):
        f = dict(zip(quality.FEATURES, row, strict=True))
        found = list(re.finditer(rb"[0-9A-Za-z\x80-\xff]+", b))
        some, one = max(len(found), 1), max(len(b), 1)
        n = lambda chars: sum(c in chars for c in b)  # noqa: B023, E731
        assert f["word_length"] == pytest.approx(len(re.findall(rb"[A-Za-z\x80-\xff]", b)) / some) and f["space"] == pytest.approx(n(b" \t\v\f\r") / one)
        assert f["stop"] == pytest.approx(n(b".?") / some) and f["comma"] == pytest.approx(n(b",;:'\"-()") / some) and f["symbol"] == pytest.approx(n(b"#") / some)
        assert f["capital_words"] == pytest.approx(sum(m[0][:1].isupper() for m in found) / some) and f["line_length"] == pytest.approx(len(found) / (b.count(b"\n") + 1))


def test_quality_by_plain_counts(spark):
    """Features from a plain count, and a score as the sum of the table entries of its bins."""
    rng = random.Random(4)
    texts = ["", "A b!", "é é É 9,9\n" * 3] + ["".join(rng.choice("abC dé,.!|\n9 ") for _ in range(rng.randrange(300))) for _ in range(60)]
    enc = [t.encode() for t in texts]
    x = quality.features(np.frombuffer(b"".join(enc), np.uint8), np.r_[0, np.cumsum([len(b) for b in enc])])
    for b, row in zip(enc, x, strict=True):
        f = dict(zip(quality.FEATURES, row, strict=True))
        words = re.findall(rb"[0-9a-z\x80-\xff]+", b.lower())
        some, one = max(len(words), 1), max(len(b), 1)
        assert f["log_bytes"] == pytest.approx(math.log1p(len(b))) and f["log_words"] == pytest.approx(math.log1p(len(words)))
        assert f["upper"] == pytest.approx(len(re.findall(rb"[A-Z]", b)) / one) and f["digit"] == pytest.approx(len(re.findall(rb"[0-9]", b)) / one)
        assert f["bang"] == pytest.approx(b.count(b"!") / some) and f["bar"] == pytest.approx(b.count(b"|") / some) and f["newline"] == pytest.approx(b.count(b"\n") / some)
        assert f["distinct_words"] == pytest.approx(len(set(words)) / some) and f["top_word"] == pytest.approx(max(Counter(words).values(), default=0) / some)
        assert f["deflated"] == pytest.approx(len(zlib.compress(b, 1)) / one) and f["beyond_ascii"] == pytest.approx(sum(c > 127 for c in b) / one)
    model = quality.fit(x, np.array([i % 3 == 0 for i in range(len(x))], float))
    assert model.pairs
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for i, row in enumerate(x):
        at = lambda edges, v: sum(e <= v for e in edges)
        z = model.base + sum(t[at(e, v)] for e, t, v in zip(model.edges, model.tables, row, strict=True)) + sum(t[at(model.coarse[a], row[a]), at(model.coarse[b], row[b])] for a, b, t in model.pairs)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)))


@pytest.mark.parametrize(("name", "label", "least"), [("op1_additive_quality", "quality", 0.9), ("op2_nearest_toxic", "toxic", 0.85)])
def test_held_out(spark, name, label, least):
    got = QUERIES[name](spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    both = got.join(table(spark, SF, "labels"), "doc_id").where("held_out").select("predicted", "score", label).collect()
    assert np.mean([r["predicted"] == r[label] for r in both]) >= least
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in both)
    assert got.count() == table(spark, SF, "documents").count()


def test_toxic_recall_and_false_hits(spark):
    got = QUERIES["op2_nearest_toxic"](spark, "/root/testdata/sf0.1").where("held_out").join(table(spark, "/root/testdata/sf0.1", "labels").where("toxic is not null"), "doc_id")
    rows = got.select("doc_id", "toxic", "predicted", "score", "evidence").collect()
    toxic, clean = ([r for r in rows if r["toxic"] == y] for y in (1, 0))
    assert len(toxic) == 120 and np.mean([r["predicted"] for r in toxic]) >= 0.93
    assert len(clean) == 870 and np.mean([r["predicted"] for r in clean]) <= 0.02
    assert abs(np.mean([r["score"] for r in rows]) - 120 / 990) < 0.02
    copy = next(r for r in rows if r["doc_id"] == 8847)  # byte for byte a labelled example without telling words
    assert copy["evidence"][0] == "8959:1:1.0000" and copy["predicted"] == 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "idiot idiot", 9), (2, None, 9), (2, "", 9), (None, "fine words", 9), (3, "x" * 100_000, 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, 1, None), (None, 1, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    for frame in (docs, docs.limit(0)):
        a = quality.score(frame, quality.train(frame, labels)).collect()
        b = toxicity.score_toxicity(frame, toxicity.build_index(frame, labels)).collect()
        assert len(a) == len(b) == frame.count() and all(0 <= r["score"] <= 1 for r in a + b)
    assert toxicity.build_index(docs, labels.limit(0)).rate == 0.5


def test_no_examples(spark):
    docs = spark.createDataFrame([(1, "idiot idiot"), (2, None), (3, "fine words"), (3, "fine words")], "doc_id long, text string")
    none, strange = (spark.createDataFrame(x, "doc_id long, toxic int") for x in ([], [(77, 1), (None, 1), (1, None)]))
    for labels in (none, strange):
        judged = toxicity.score_toxicity(docs, toxicity.build_index(docs, labels)).collect()
        assert len(judged) == 4 and all(r["predicted"] == 0 and r["score"] == 0 and r["evidence"] == [] for r in judged)


def test_stage_keeps_all_without_examples(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "idiot idiot"), (2, None), (3, "fine words"), (3, "fine words")], "doc_id long, text string")
    assert sorted(map(str, corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))


def plain_terms(text):
    """Counts of words and of their first five bytes."""
    words = re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return Counter([(0, w) for w in words] + [(1, w[:5]) for w in words if len(w) >= 5])


def plain_neighbours(examples, counts, k):
    """(cosine, place) of the k nearest examples, given as (counts, label), over whole TF-IDF vectors."""
    n, yes = len(examples), sum(y for _, y in examples)
    df, seen = Counter(t for c, _ in examples for t in c), Counter(t for c, y in examples if y for t in c)

    def weight(t):
        if t not in df:
            return math.log(1 + n) + 1
        r = (seen[t] / max(yes, 1)) / ((df[t] - seen[t] + 5) / max(n - yes, 1))
        return (math.log((1 + n) / (1 + df[t])) + 1) * math.log2(2 + r) ** 2

    def unit(c):
        v = {t: (1 + math.log(x)) * weight(t) for t, x in c.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}

    q = unit(counts)
    sims = [(sum(x * q[t] for t, x in unit(c).items() if t in q), i) for i, (c, _) in enumerate(examples)]
    return sorted((s for s in sims if s[0] > 0), reverse=True)[:k]


def plain_vote(near, labels):
    w = [c / max(1 - c, 1e-4) for c, _ in near]
    return sum(x * labels[i] for x, (_, i) in zip(w, near, strict=True)) / sum(w) if w else None


def prose(seed, texts, common, own, insults):
    """Texts of common words and words of their own; every fourth one holds an insult."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randrange(3, 9)))
    pool = [word() for _ in range(common)]
    return {i: " ".join(rng.choices(pool, k=20) + [word() for _ in range(own)] + rng.choices(insults, k=i % 4 == 0)) for i in range(texts)}


@pytest.mark.parametrize(("share", "block"), [(24, 64), (3, 7), (0, 16), (10**9, 16)])
def test_neighbours_are_exact(monkeypatch, share, block):
    monkeypatch.setattr(toxicity, "COMMON_SHARE", share)
    texts = prose(3, 300, 60, 5, ["vile", "vileness"])
    read = lambda t: toxicity.Counts.read(np.frombuffer("".join(t).encode(), np.uint8), np.r_[0, np.cumsum([len(x.encode()) for x in t])])
    known, asked = [texts[i] for i in range(250)], [*(texts[i] for i in range(250, 300)), texts[4], "", "12 34", "x" * 300_000]
    y = np.array([i % 4 == 0 for i in range(250)], float)
    c = read(known)
    index = pickle.loads(pickle.dumps(toxicity.ExampleIndex(list(range(250)), y, c.text, c.terms[c.term], c.n, 7, block)))
    found, sims = index.nearest(read(asked))
    assert share or not (index.column >= 0).any()
    examples = [(plain_terms(t), v) for t, v in zip(known, y, strict=True)]
    for i, text in enumerate(asked):
        want = plain_neighbours(examples, plain_terms(text), 7)
        assert np.allclose(sims[i, : len(want)], [c for c, _ in want], atol=4e-6) and not sims[i, len(want) :].any()
        cosine = {p: c for c, p in plain_neighbours(examples, plain_terms(text), 250)}
        assert np.allclose([cosine[p] for p in found[i, : len(want)]], [c for c, _ in want], atol=4e-6)
        vote = plain_vote(want, y)
        got = index.votes(found[i : i + 1], sims[i : i + 1])[0]
        assert np.isnan(got) if vote is None else abs(got - vote) < 0.02


def test_query_against_brute_force(spark, tmp_path):
    """Votes, calibration and evidence of the registered query, from whole texts up."""
    texts = prose(11, 160, 50, 6, ["vile", "vileness", "villain"])
    docs = [*texts.items(), (200, texts[8]), (201, None), (202, "4 5 6"), (203, texts[9] + " vile"), (None, "vile"), (8, texts[8] + " zz")]
    label = {i: int(i % 4 == 0) for i in texts if i % 3}
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*label.items(), (None, 1), (500, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["op2_nearest_toxic"](spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    learned = {i: y for i, y in label.items() if zlib.crc32(str(i).encode()) % 4 != 2}
    order = [r["doc_id"] for r in spark.createDataFrame([(i,) for i in learned], "doc_id long").orderBy(F.xxhash64("doc_id")).collect()]
    examples = [(plain_terms(texts[i]), learned[i]) for i in order]
    pairs = []
    for f in range(5):
        rest = [e for i, e in enumerate(examples) if i % 5 != f]
        for i, (c, y) in enumerate(examples):
            if i % 5 == f:
                pairs.append((plain_vote(plain_neighbours(rest, c, 10), [y for _, y in rest]), y))
    points = sorted([(v, float(y)) for v, y in pairs] + [(x / 10, x / 10) for x in range(11)], key=lambda p: (round(p[0], 9), -p[1]))
    # the isotonic fit by its definition: greatest of the least means
    mean = lambda a, b: sum(y for _, y in points[a:b]) / (b - a)
    fit = [max(min(mean(a, b) for b in range(i + 1, len(points) + 1)) for a in range(i + 1)) for i in range(len(points))]
    curve = {}
    for (v, _), p in zip(points, fit, strict=True):
        curve.setdefault(round(p, 9), []).append(v)
    knots = [np.mean(v) for v in curve.values()], list(curve)
    by = dict(docs[:-2])
    for r in got:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3)
        if r["doc_id"] in (None, 8):
            continue
        near = plain_neighbours(examples, plain_terms(by[r["doc_id"]]), 10)
        assert [float(e.split(":")[2]) for e in r["evidence"]] == pytest.approx([c for c, _ in near[:5]], abs=2e-4)
        assert all(int(e.split(":")[1]) == learned[int(e.split(":")[0])] for e in r["evidence"])
        if len(near) < 10 or near[4][0] - near[5][0] > 1e-5:
            assert {int(e.split(":")[0]) for e in r["evidence"]} == {order[i] for _, i in near[:5]}
        vote = plain_vote(near, [y for _, y in examples])
        if vote is not None:
            assert r["score"] == pytest.approx(np.interp(vote, *knots), abs=0.03), r
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[200] > 0.9 and score[203] > 0.3 and score[201] == score[202] < 0.3
    assert next(r["evidence"][0] for r in got if r["doc_id"] == 200) == "8:1:1.0000"


def test_examples_have_a_bound(spark):
    docs = spark.createDataFrame([(i, f"alpha beta{i % 26} {chr(97 + i % 26) * 9}") for i in range(60)] + [(5, "zz")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert toxicity.build_index(docs, labels, most=20).n == 20
    small = toxicity.build_index(docs, labels, postings=100)
    assert small.df.sum() <= 100 < small.df.sum() + 20 and 0 < small.n < 60


def test_pipeline(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after = docs.count()
        assert 0.5 * before < after <= (2 * before if name == "source_mixing" else before), name
        before = after
    got = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert got.count() == before and set(columns) < set(got.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "source_mixing", "sharding"]


def test_held_out_rows(spark):
    df = spark.createDataFrame([(5,), (None,)], "doc_id long").select(crc_text("doc_id").alias("c")).collect()
    import zlib

    assert [r["c"] for r in df] == [zlib.crc32(b"5"), 0]
