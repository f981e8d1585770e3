"""Operators with exact results against brute force, on rows with nulls, repeats, empty texts and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from heirloom.llm import common, metric_join, mixture, preferences, sharding, shingle_join, suffix_dedup, url_rules, winnowing

WORDS = "the of and to ab cd ef gh ij kl mn op qr st uv wx yz éa ßo ñu".split()


def texts(rng, n, low=0, high=60):
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(low, high))) for _ in range(n)]


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# ---- url rules


def test_url_rules(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", None), ("allow", None, "/free/"), ("block", "a+b.org", "/x.y"), ("allow", "tie.org", "/"), ("block", "tie.org", "/")]
    ends = [f"http://a{e}b.com/en/{e}x{e}" for e in ("\n", "\r", "\r\n", "\u2028", "\u0085")] + ["http://com\n/en/", "http://x.com\n.net/", "http://q.io/free\n/1", "http://q.io\n/free/1", "http://long.com/en/" + "x\ny" * 50_000]
    urls = [*ends, "http://EXAMPLE.com/en/72?x", "http://x.example.com/en/6", "https://notexample.com/en/7", "http://com/en/", "http://net", "http://tie.org/", "ftp://a+b.org/x.yz#f", "http://aab.org/x.y", "http://q.io/free/1", "nothing", "", None, "http://q.io?/en/", "http://xnet/"] * 2
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in url_rules.judge_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len((h or "") + (p or "/")), v == "allow", (h or "") + (p or "/"), v) for v, h, p in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p or "/")]
        best = max(fit, default=(0, 0, None, "allow"))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, best[2], best[3]), u
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge_urls(empty, spark.createDataFrame(rules, "verdict string, host string, path string")).count() == 0


# ---- mixing


def waterfill(sizes, weights, total, cap):
    left, out = dict(sizes), {}
    while left:
        w = sum(weights[s] for s in left)
        share = {s: total * weights[s] / w for s in left}
        over = [s for s in left if share[s] > cap * left[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = cap * left.pop(s)
            total -= out[s]
    return out


def test_mixture(spark):
    rng = random.Random(1)
    rows = [(i if i % 9 else None, rng.choice(["a", "b", "b", "b", "b", "c", None, "zero"]), t, 5) for i, t in enumerate(texts(rng, 300))]
    rows = [(i, s, None if s == "zero" else t, x) for i, s, t, x in rows] + rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    got = mixture.mix(docs).collect()
    assert sorted(Counter((r["doc_id"], r["source"]) for r in got).items(), key=str) == sorted(Counter((r[0], r[1]) for r in rows).items(), key=str)
    sizes = Counter()
    for _, s, t, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(s for s in sizes if s is not None) + [None]
    want = waterfill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), 2)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        assert r["taken"] == 0 or 0 <= r["position"] <= 1
    for s in sizes:
        assert taken[s] == int(want[s] + 1e-9)
    assert sorted(map(str, got)) == sorted(map(str, mixture.mix(docs).collect()))
    stream = mixture.mixed_stream(docs, least=1)
    assert stream.columns == docs.columns
    seen = Counter(r["doc_id"] for r in stream.where("doc_id IS NOT NULL").collect())
    assert set(seen) == {r[0] for r in rows if r[0] is not None} and max(seen.values()) > 1
    assert stream.schema == docs.schema and set(map(tuple, stream.collect())) == set(rows)  # clashing columns keep their values
    assert mixture.mix(docs.limit(0)).count() == 0 and mixture.mixed_stream(docs.limit(0)).count() == 0


def test_mixture_weights_and_slopes(spark):
    rows = [(i, "abcd"[i % 4], "w " * (1 + i % 7)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixture.mix(docs, weights=(0.5, 0.25), slopes=(0.5, -0.5, 0.0)).collect()
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len(t.split())
    want = waterfill(sizes, {"a": 2, "b": 1, "c": 2, "d": 1}, 1.5 * sum(sizes.values()), 2)
    slope = {"a": 0.5, "b": -0.5, "c": 0.0, "d": 0.5}
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["slope"] == slope[r["source"]]
        if r["position"] is not None:
            assert r["position"] + r["slope"] * (r["position"] ** 2 - r["position"]) == pytest.approx(r["done"], abs=1e-9)
    with pytest.raises(ValueError, match="positive"):
        mixture.mix(docs, weights=(1, 0))


# ---- sharding


def test_communication_matrix():
    rng = random.Random(4)
    counts = [rng.randrange(200) for _ in range(50)]
    m = sharding.communication_matrix(counts, 8, "s")
    assert [sum(r) for r in m] == counts
    cols = [sum(c) for c in zip(*m, strict=True)]
    assert max(cols) - min(cols) <= 1 and m == sharding.communication_matrix(counts, 8, "s")
    draws = [sharding.hypergeometric(random.Random(i), 30, 70, 20) for i in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.15 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.3


def test_shards_model(spark):
    """The query's rows from a plain model of draw, cut and rank."""
    rng = random.Random(6)
    rows = [(rng.choice([None, i, i, i]), rng.choice([None, "", "é", "xyz" * (i % 5)])) for i in range(400)]
    key = lambda seed, *v: hashlib.md5("|".join([seed, *("\x00" if x is None else str(x) for x in v)]).encode()).hexdigest()
    full = [(k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    buckets: dict = {}
    for r in full:
        buckets.setdefault(key("shard-bucket", *r)[:3], []).append(r)
    names = sorted(buckets)
    matrix = sharding.communication_matrix([len(buckets[b]) for b in names], 8, "shard")
    shards: list[list] = [[] for _ in range(8)]
    for b, counts in zip(names, matrix, strict=True):
        own = iter(sorted(buckets[b], key=lambda r: (key("shard-local", *r), *order(r))))
        for k, n in enumerate(counts):
            shards[k] += [next(own) for _ in range(n)]
    want = [(*r, k, slot) for k, own in enumerate(shards) for slot, r in enumerate(sorted(own, key=lambda r: (key("shard-slot", *r), *order(r))))]
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_shards(spark):
    rng = random.Random(2)
    rows = [(i if i % 7 else None, rng.choice([None, "", "éß", "x" * 5000]), 1) for i in range(501)] + [(3, "x", 1)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    got = sharding.shard(docs).collect()
    assert len(got) == len(rows)
    count = Counter(r["shard"] for r in got)
    assert set(count) == set(range(8)) and max(count.values()) - min(count.values()) <= 1
    for k, n in count.items():
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(n))
    for r in got:
        b = (r["text"] or "").encode()
        assert r["size"] == len(b) + 1 and r["text_crc32"] == zlib.crc32(b) and r["law"] == "rows" and r["grown_shard"] is None
    assert sharding.shard(docs.limit(0)).count() == 0


def test_rows_without_a_key_are_spread(spark):
    """Of rows that nine in ten have no id the buckets of order keys hold like numbers, in shards and in the mix."""
    rows = [(i if i % 10 == 0 else None, f"text {i} " + "w " * (i % 7), "one") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = docs.withColumns({"size": F.octet_length("text").cast("long"), "text_crc32": F.crc32(F.col("text").cast("binary")), "mark": mixture.text_mark("text")})
    for key in (common.order_key("doc_id", "size", "text_crc32", seed="shard-bucket"), common.order_key("doc_id", "size", "mark", seed="mix")):
        counts = [r["count"] for r in sized.groupBy(F.substring(key, 1, 1)).count().collect()]
        assert len(counts) == 16 and max(counts) < 2 * len(rows) / 16
    got = sharding.shard(docs).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("last")).collect()
    assert sorted((r["n"], r["last"]) for r in got) == [(1000, 999)] * 8
    taken = mixture.mix(docs, share_num=1).agg(F.sum("taken")).first()[0]
    assert taken == sum(len(t.split()) for _, t, _ in rows) // 2


# ---- preference formatting


def test_preferences(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (2, 0, "user", "q"), (2, 1, "assistant", "b"), (3, 0, "user", "q"), (3, 1, "assistant", "a"), (4, 0, None, None), (5, 0, "user", "q"), (5, 1, "assistant", "a"), (None, 0, "system", "s"), (None, 0, "system", "s"), (None, 0, "user", "q"), (None, 1, "assistant", "a"), (6, 0, "user", "u"), (6, 0, "assistant", "v"), (6, 0, "user", "u")]
    df = spark.createDataFrame([(*t, "clash", -1) for t in turns], "conv_id long, turn long, role string, text string, status string, n_common long")
    pairs = spark.createDataFrame([(1, 2, True), (3, 5, True), (1, 3, True), (4, None, False), (2, None, False), (9, 1, True), (6, None, False)], "chosen_id long, rejected_id long, paired boolean")
    out = preferences.format_preferences(df, pairs).collect()
    got = {(r["chosen_id"], r["rejected_id"]): r for r in out}
    assert got[6, None]["prompt"] == "" and got[6, None]["chosen"] == "<|assistant|>\nv<|end|>\n" + 2 * "<|user|>\nu<|end|>\n"
    alone = Counter((r["status"], r["prompt"], r["chosen"], r["rejected"]) for r in out if r["chosen_id"] is None)
    assert alone == Counter({("single", "<|system|>\ns<|end|>\n", "", None): 2, ("single", "<|user|>\nq<|end|>\n", "", None): 1, ("single", "", "<|assistant|>\na<|end|>\n", None): 1})
    u = "<|user|>\nq<|end|>\n"
    assert got[1, 2]["prompt"] == u and got[1, 2]["status"] == "pair" and got[1, 2]["rejected"] == "<|assistant|>\nb<|end|>\n"
    text, span = got[1, 2]["chosen"], got[1, 2]["chosen_loss"]
    a, b = map(int, span.split("-"))
    assert text[a:b] == "a<|end|>\n"
    assert got[3, 5]["status"] == "identical" and got[3, 5]["chosen"] == "" and got[1, 3]["status"] == "prefix" and got[1, 3]["rejected"] == ""
    assert got[4, None]["status"] == "single" and got[4, None]["prompt"] == "<|user|>\n<|end|>\n" and got[4, None]["chosen"] == ""
    assert got[2, None]["prompt"] == u and got[2, None]["rejected"] is None and got[9, 1]["n_common"] == 0
    found = preferences.opening_pairs(df).collect()
    ids = Counter(x for r in found for x in ([r["chosen_id"], r["rejected_id"]] if r["paired"] else [r["chosen_id"]]))
    assert ids == Counter([1, 2, 3, 4, 5, 6])
    assert preferences.format_preferences(df.limit(0), preferences.opening_pairs(df.limit(0))).count() == 0


# ---- winnowing


def brute_hits(text, items):
    w = split(text)
    hit, found = set(), set()
    for i, t in items:
        v = split(t)
        n = min(10, len(v))
        grams = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else set()
        for j in range(len(w) - n + 1):
            if n and tuple(w[j : j + n]) in grams:
                hit |= set(range(j, j + n))
                found.add("null" if i is None else str(i))
    return len(w), len(hit), found


@pytest.mark.parametrize("block", [winnowing.BLOCK_BYTES, 900])
def test_winnowing(spark, block):
    rng = random.Random(6)
    items = [(i, t) for i, t in enumerate(texts(rng, 30, 8, 40))] + [(100, "ab cd ef"), (101, "zz"), (None, texts(rng, 1, 20, 21)[0]), (102, None), (103, "--")]
    items += [items[0], (7, items[1][1])]
    docs = [(i, t, "clash") for i, t in enumerate(texts(rng, 60, 0, 80))]
    for i in range(30):
        v = split(items[i][1])
        s = rng.randrange(max(1, len(v) - 12))
        docs.append((100 + i, texts(rng, 1)[0].upper() + " - " + "_".join(v[s : s + rng.randrange(8, 15)]) + "! ab", "x"))
    docs += [(200, None, "x"), (201, "", "x"), (201, "", "x"), (None, "AB-cd.ef", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_hit string")
    got = winnowing.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hit, found = brute_hits(r["text"], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0), r
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    none = spark.createDataFrame([], "item_id long, text string")
    for least in (block, -1):
        assert winnowing.decontaminate(df, none, block_bytes=least).where("contaminated").count() == 0 and winnowing.decontaminate(df.limit(0), none, block_bytes=least).count() == 0


@pytest.mark.parametrize("block", [winnowing.BLOCK_BYTES, 900])
def test_winnowing_of_copies_and_long_words(spark, block):
    rng = random.Random(16)
    giant = ["x" * 300_000, "x" * 299_999 + "y", "é" * 150_000]
    passage = [*giant, *(f"w{i}" for i in range(12))]
    items = [(1, " ".join(passage)), (2, "the the"), (2, "the the"), (3, " ".join(["ab"] * 40)), (4, "w1 w2 w3 " + "cd " * 20)]
    docs = [("id", i % 3, "the  THE ab " * 30 + " ".join(passage)) for i in range(40)]
    docs += [("id", 50, " ".join(passage[1:11])), ("id", 51, " ".join(passage[1:10])), ("id", 52, " ".join([giant[1], *passage[1:10]])), ("id", 53, " ".join(rng.choice(["the", "ab", "cd"]) for _ in range(20_000))), ("id", None, None)]
    df = spark.createDataFrame(docs, "owner string, start long, text string").repartition(5)
    got = winnowing.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    assert got.columns[:3] == ["owner", "start", "text"]
    got = got.collect()
    assert len(got) == len(docs) and {r["owner"] for r in got} == {"id"}
    model = {t: brute_hits(t, items) for _, _, t in set(docs)}
    for r in got:
        n, hit, found = model[r["text"]]
        spans = r["hit_spans"]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0)
        assert sum(spans[1::2]) - sum(spans[::2]) == hit and spans == sorted(spans)
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_winnowing_compares_words(monkeypatch):
    """With hashes that mostly collide the index still finds the right words, and nothing else."""
    real = winnowing.gram_hashes
    monkeypatch.setattr(winnowing, "gram_hashes", lambda hashes, k, seed=1: real(hashes, k, seed) % np.uint64(2))
    rng = random.Random(26)
    items = list(enumerate(texts(rng, 12, 0, 30)))
    index = winnowing.Index([str(i) for i, _ in items], [t for _, t in items])
    for t in [*texts(rng, 8, 0, 50), *(f"ab {t} cd" for _, t in items)]:
        hit, found = set(), set()
        for at, n, which, item in index.hits(winnowing.Words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))):
            hit |= {int(a) + j for a in at for j in range(n)}
            found |= {str(i) for i in item}
            assert len(which) == len(item)
        assert (len(hit), found) == brute_hits(t, items)[1:]


# ---- vectors


def closure(n, links):
    up = list(range(n))
    for a, b in links:
        while up[a] != up[up[a]]:
            up[a] = up[up[a]]
        ra, rb = a, b
        while up[ra] != ra:
            ra = up[ra]
        while up[rb] != rb:
            rb = up[rb]
        up[max(ra, rb)] = min(ra, rb)
    for i in range(n):
        r = i
        while up[r] != r:
            r = up[r]
        up[i] = r
    return up


@pytest.mark.parametrize("large", [16384, 12])
def test_metric_join(spark, monkeypatch, large):
    monkeypatch.setattr(metric_join, "LARGE", large)
    monkeypatch.setattr(metric_join, "PER_INNER", 4)
    monkeypatch.setattr(metric_join, "TRIAL", 2)
    monkeypatch.setattr(metric_join, "PER_PIVOT", 40)
    monkeypatch.setattr(metric_join, "BLOCK", 16)
    monkeypatch.setattr(metric_join, "STREAM", 1)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    rows = []
    for i in range(260):
        v = centres[rng.integers(12)] + rng.normal(size=6) * 0.25
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2) if i < 250 else None))
    rows += [(300 + i, rows[0][1], rows[0][2]) for i in range(30)]
    rows += [(400, None, 1), (401, [0.0] * 6, 1), (402, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], 1), (403, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (404, [1.0, 2.0], 1), (405, [], 1), (406, [float("inf")] * 6, 1), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("clash"))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in metric_join.near_vectors(df).collect())
    links = []
    fine = [i for i, (_, v, l) in enumerate(rows) if v and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in fine}
    for a in fine:
        links += [(a, b) for b in fine if b > a and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    deg = Counter(x for p in links for x in p)
    up = closure(len(rows), links)
    low = {}
    for i, r in enumerate(up):
        low[r] = min(low.get(r, 10**9), rows[i][0])
    assert got == sorted((rows[i][0], deg[i], low[up[i]], rows[i][0] == low[up[i]]) for i in range(len(rows)))
    assert metric_join.near_vectors(df.limit(0)).count() == 0


def test_large_cells(spark, monkeypatch):
    """Cells that hold clusters are cut until they are small, with every pair in one cell; a cell of equal distances stays whole."""
    for name, value in {"LARGE": 60, "PER_INNER": 10, "TRIAL": 2, "BLOCK": 16, "STREAM": 2}.items():
        monkeypatch.setattr(metric_join, name, value)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8))
    spots = {"clusters": centres[rng.integers(40, size=1000)] + rng.normal(size=(1000, 8)) * 0.05, "spread": np.eye(128)}
    rows = [(f"{cell}{i}", 0, len(v), cell, [float(x) for x in v / np.linalg.norm(v)], 1, i % 5 > 0) for cell, block in spots.items() for i, v in enumerate(block)]
    cells = spark.createDataFrame(rows, "key string, label int, dim int, cell string, unit array<double>, m long, home boolean").select("key", "label", "dim", "unit", "m", "cell", "home")
    eps = math.sqrt(2 - 2 * 0.93) + metric_join.SLACK
    cut, sizes = metric_join.nested(cells, eps)
    held = {}
    for r in cut.select("key", "cell", "home").collect():
        held.setdefault(r["cell"], ([], []))[not r["home"]].append(r["key"])
    assert {r["cell"]: (r["nh"], r["nc"]) for r in sizes.collect()} == {c: (len(h), len(h) + len(g)) for c, (h, g) in held.items() if h}
    assert (len(held["spread"][0]), len(held["spread"][1])) == (102, 26)
    work = sum(len(h) * (len(h) + len(g)) for c, (h, g) in held.items() if c != "spread")
    assert work < 800 * 1000 / 4 and max(len(h) for c, (h, _) in held.items() if c != "spread") <= 100
    met = Counter(frozenset(p) for h, g in held.values() for p in [*itertools.combinations(h, 2), *itertools.product(h, g)])
    at = {r[0]: np.array(r[4]) for r in rows if r[3] == "clusters"}
    homes = {r[0] for r in rows if r[6]}
    for a, b in itertools.combinations(at, 2):
        if at[a] @ at[b] >= 0.93 and (a in homes or b in homes):
            assert met[frozenset((a, b))] == 1
    assert set(met.values()) == {1}


# ---- near texts


def test_near_texts(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "STREAM", 1)
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randrange(40, 160))]
        for _ in range(rng.randrange(1, 14)):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            rows.append(" ".join(t))
    rows += ["one two", "one, TWO!", "one", "", "", None, "!!!", "!!!", "??", rows[0].upper(), " ".join(vocab), " ".join(vocab[:2990])]
    docs = spark.createDataFrame([(i * 3 % 997, t, "k") for i, t in enumerate(rows)] + [(None, rows[0], "k"), (0, rows[0], "k")], "doc_id long, text string, kept string")
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = []
    for _, t in data:
        w = split(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else None)
    links = []
    for a in range(len(data)):
        for b in range(a + 1, len(data)):
            x, y = sets[a], sets[b]
            if (x and y and len(x & y) >= 0.8 * len(x | y)) or (not x and not y and (data[a][1] or "") == (data[b][1] or "")):
                links.append((a, b))
    deg, up = Counter(x for p in links for x in p), closure(len(data), links)
    low = {}
    for i, r in enumerate(up):
        if data[i][0] is not None:
            low[r] = min(low.get(r, 10**9), data[i][0])
    want = sorted((str(data[i][0]), low.get(up[i]), deg[i], data[i][0] == low.get(up[i])) for i in range(len(data)))
    got = sorted((str(r["doc_id"]), r["class_id"], r["n_links"], r["kept"]) for r in shingle_join.near_texts(docs, block=8).collect())
    assert got == want
    left = shingle_join.drop_near_copies(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(set(low.values()))


def drifting(n, words=120):
    """Texts of which each has two words that the one before has not."""
    rng = random.Random(n)
    text, out = [f"w{rng.randrange(10**9)}" for _ in range(words)], []
    for _ in range(n):
        at = rng.randrange(words - 1)
        text[at : at + 2] = f"w{rng.randrange(10**9)}", f"w{rng.randrange(10**9)}"
        out.append(" ".join(text))
    return out


def test_drifting_families_cost_what_they_link(spark, monkeypatch):
    """A loose chain is verified in the nodes where its texts meet: what is compared grows with the chain, not with its square, and no link is lost or counted twice."""
    compared, groups = [], shingle_join.verification_groups

    def counted(*args):
        out = groups(*args)
        compared.append(out.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0])
        return out

    monkeypatch.setattr(shingle_join, "verification_groups", counted)
    for n in (300, 600):
        texts = drifting(n)
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
        links = [sum(i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets[max(0, i - 8) : i + 9], max(0, i - 8))) for i, a in enumerate(sets)]
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[9])], "doc_id long, text string")
        want = Counter()
        for i in [*range(n), 5, 9]:
            want[links[i] + sum(c - 1 for j, c in ((5, 2), (9, 2)) if j == i or i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))] += 1
        got = shingle_join.near_texts(docs, block=16).collect()
        assert Counter(r["n_links"] for r in got) == want and len({r["class_id"] for r in got}) >= 1
    assert compared[1] < 2.6 * compared[0] and compared[1] < 600 * 600 / 2


def test_near_texts_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert shingle_join.near_texts(docs).count() == 0
    assert shingle_join.drop_near_copies(docs).count() == 0


def test_bounds_of_the_forest():
    assert shingle_join.shortest_prefix(24, 6, 0.9999, 0.8) == 5
    assert shingle_join.shortest_prefix(24, 9, 0.99, 0.8) == 7
    with pytest.raises(ValueError, match="recall"):
        shingle_join.shortest_prefix(1, 6, 0.9999, 0.8)
    for hashes, least in ((12, 0.8), (144, 0.8), (30, 0.5)):
        k = shingle_join.surely_equal(hashes, least)
        tail = lambda k: sum(math.comb(hashes, j) * least**j * (1 - least) ** (hashes - j) for j in range(k))  # noqa: E731, B023
        assert tail(k) <= 1e-6 < tail(k + 1)


def test_drop_near_copies_by_row(spark):
    """Unrelated texts with null or with equal keys stay; a copy under another key goes; of equal rows one stays."""
    rows = [
        (None, "alpha", "r", 1), (None, "beta", "r", 1),
        (5, "gamma", "r", 1), (5, "delta", "r", 1),
        (3, "epsilon", "r", 1), (6, "zeta", "r", 1), (6, "epsilon ", "r", 1),
        (7, "eta", "r", 1), (7, "eta", "r", 1), (7, "eta", "r", 1), (None, "eta", None, 1), (8, "eta", "r", 2),
        (4, None, None, None), (2, "", "r", None), (None, None, None, None), (9, "!", "r", 1),
    ]
    got = [tuple(r) for r in shingle_join.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, row string, Times long")).collect()]
    assert sorted(got, key=str) == sorted([*rows[:6], rows[7], rows[13], rows[15]], key=str)


def test_drop_near_copies_model(spark):
    """One row of each connected group, the one with the smallest key, whatever keys repeat or are null."""
    rng = random.Random(21)
    bases = [[rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(30, 80))] for _ in range(15)]
    rows = []
    for _ in range(90):
        t = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 3)):
            t[rng.randrange(len(t))] = "changed"
        rows.append((rng.choice([None, *range(40)]), " ".join(t), rng.randrange(2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (split(t) for _, t, _ in rows)]
    up = closure(len(rows), [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    groups: dict = {}
    for i, r in enumerate(up):
        groups.setdefault(r, []).append(rows[i])
    got = [tuple(r) for r in shingle_join.drop_near_copies(docs).collect()]
    assert len(got) == len(groups) < len(rows)
    for own in groups.values():
        least = min((k is None, k or 0) for k, _, _ in own)
        assert sum(r in own for r in got) == 1 and next((r[0] is None, r[0] or 0) for r in got if r in own) == least


def test_recall_at_the_least_similarity(spark):
    """Pairs just above the threshold, against brute force."""
    rng = random.Random(5)
    rows = []
    for i in range(700):
        w = [f"{i}x{j}" for j in range(49)]
        u = list(w)
        u[rng.randrange(44)] = "other"  # 40 or more of 50 shingles are shared: similarity 0.8 or little more
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(u))]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    links = {2 * i for i in range(700) if len(sets[2 * i] & sets[2 * i + 1]) >= 0.8 * len(sets[2 * i] | sets[2 * i + 1])}
    assert len(links) == 700
    got = {r["doc_id"]: r["class_id"] for r in shingle_join.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i + 1] == i for i in links) >= 0.999 * len(links)


# ---- what operators leave behind


def test_nothing_is_left(spark):
    """After a scratch block the shared folder is as before, and no operator leaves a table in the catalog."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    there = lambda: {p.name for p in shared.iterdir()} if shared.exists() else set()
    before = there()
    docs = spark.createDataFrame([(i, "a b c d e f g " * 12 + str(i % 3)) for i in range(9)], "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [1.0, float(i % 2)], 1) for i in range(9)], "vec_id long, embedding array<double>, label int")
    with common.scratch(spark):
        results = [shingle_join.drop_near_copies(docs), suffix_dedup.repeated_spans(docs), metric_join.near_vectors(vectors)]
        assert [r.count() for r in results] == [3, 9, 9] and len(there() - before) == 1
    assert there() == before and not spark.catalog.listTables()


# ---- repeated strings


def brute_removed(data):
    seen, out = set(), []
    for key, text in sorted(data, key=lambda d: (d[0] is None, d[0])):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                gone[p : p + 100] = True
            seen.add(s)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((key, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def test_repeated_spans(spark):
    rng = random.Random(9)
    share = "".join(rng.choice("abcdefé ") for _ in range(400))
    rows = []
    for i in range(60):
        own = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 300)))
        s = rng.randrange(0, 250)
        rows.append((i * 2, own + share[s : s + rng.randrange(60, 180)] + own[:130]))
    rows += [(1, "a" * 500), (3, "ab" * 200), (5, "a" * 120 + "b"), (7, None), (9, ""), (11, rows[4][1]), (13, rows[4][1]), (None, share), (15, "x" * 99), (17, "x" * 99), (19, "é" * 50), (21, "é" * 51)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_bytes string")
    got = suffix_dedup.repeated_spans(docs, limit=2000)
    found = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()]
    assert sorted(found, key=str) == sorted(brute_removed(rows), key=str)
    again = suffix_dedup.repeated_spans(docs.unionByName(docs.limit(1)))
    assert again.count() == len(rows) + 1


@pytest.mark.parametrize(("hot", "salts"), [(1, 1), (3, 2), (8, 64)])
def test_repeated_spans_of_hot_anchors(spark, hot, salts):
    """Passages of many lengths in many texts, with contexts that differ, agree on one side or repeat."""
    rng = random.Random(hot)
    passages = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (40, 70, 99, 100, 101, 130, 300)]
    ends = ["".join(rng.choice("xyz") for _ in range(90)) for _ in range(3)]
    rows = []
    for i in range(120):
        own = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 120))) for _ in range(2)]
        p = rng.choice(passages)
        rows.append((i * 3, rng.choice([own[0], *ends]) + p + rng.choice([own[1], *ends]) + (p if rng.random() < 0.3 else "")))
    rows += [(1, "a" * 700), (2, "ab" * 300), (4, "b" + "a" * 300)]
    got = suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), limit=3000, hot=hot, salts=salts)
    found = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()]
    assert sorted(found, key=str) == sorted(brute_removed(rows), key=str)


def test_repeated_spans_empty(spark):
    assert suffix_dedup.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(60):
        segs = [bytes(rng.choice(b"ab" if rng.random() < 0.5 else b"abcdefgh") for _ in range(rng.randrange(1, 250))) for _ in range(4)]
        segs.append(b"a" * rng.randrange(1, 240))
        begin, rid = [rng.randrange(50) for _ in segs], [rng.randrange(3) for _ in segs]
        w, o = suffix_dedup.later_windows(np.frombuffer(b"".join(segs), np.uint8), np.r_[0, np.cumsum([len(s) for s in segs])], np.array(rid), np.array(begin))
        groups: dict = {}
        for i, s in enumerate(segs):
            for p in range(len(s) - 99):
                groups.setdefault(s[p : p + 100], []).append((rid[i], begin[i] + p))
        assert sorted((rid[i], begin[i] + p) for i, p in zip(w, o, strict=True)) == sorted(x for v in groups.values() for x in sorted(v)[1:])
