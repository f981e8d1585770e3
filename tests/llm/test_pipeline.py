"""Rows of the pipeline's stages, each from a plain model of its own input, and odd tables through all of them."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heirloom.llm import toxicity
from heirloom.llm.common import table

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def first_copies(docs):
    """Ids that stay of (id, text): the smallest of each group that links of similarity 0.8 connect."""
    sets = []
    for _, text in docs:
        w = plain_words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {(text or "",)})
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 0.8 * max(len(a), len(sets[j])) <= min(len(a), len(sets[j])) and len(a & sets[j]) >= 0.8 * len(a | sets[j]) - 1e-9:
                x, y = sorted((root(i), root(j)), key=lambda k: docs[k][0])
                up[y] = x
    return {docs[root(i)][0] for i in range(len(docs))}


def leaked(text, items):
    w = plain_words(text)
    for item in items:
        v = plain_words(item)
        n = min(10, len(v))
        if n and {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} & {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}:
            return True
    return False


def mixed_times(docs):
    """How often each (id, text, source) comes: once by its own size, and of favoured sources some again, up to 150 % of all words and twice a source."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    total = {s: sum(size[i] for i, _, x in docs if x == s) for s in {s for _, _, s in docs}}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    left, target, rest = dict(total), {}, 0.5 * sum(total.values())
    while left:
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > left[s]]
        for s in over or left.copy():
            target[s] = total[s] + (total[s] if over else share[s])
            rest -= left.pop(s) if over else 0
            if not over:
                left.pop(s, None)
    out = {}
    for s in total:
        own = sorted((i for i, _, x in docs if x == s), key=lambda i: hashlib.md5(f"mix|{i}|{size[i]}|{hashlib.md5((text_of[i] or '').encode()).hexdigest()}".encode()).hexdigest()) if (text_of := {i: t for i, t, _ in docs}) else []
        whole = math.floor(target[s] / total[s]) if total[s] else 0
        spare = math.floor(target[s] + 1e-9) - whole * total[s]
        for i in own:
            more = max(0, min(spare, size[i]))
            spare -= size[i]
            out[i] = math.ceil((whole * size[i] + more) / size[i]) if size[i] else 1
    return out


def test_rows_of_every_stage(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns

    def kept(df):
        rows = df.collect()
        return spark.createDataFrame(rows, df.schema), rows

    docs, given = kept(docs)
    index = toxicity.build_index(docs, table(spark, SF, "labels"))
    fine = {r["doc_id"] for r in toxicity.score_toxicity(docs, index).collect() if r["score"] < 0.3}
    docs, rows = kept(STAGE["toxicity"](spark, docs, SF))
    assert sorted(map(tuple, rows)) == sorted(tuple(r) for r in given if r["doc_id"] in fine) and 0 < len(rows) < len(given)

    want = first_copies([(r["doc_id"], r["text"]) for r in rows])
    docs, after = kept(STAGE["ngram_jaccard_join"](spark, docs, SF))
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in rows if r["doc_id"] in want) and len(after) < len(rows)

    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    docs, rows = kept(STAGE["decontamination"](spark, docs, SF))
    assert sorted(map(tuple, rows)) == sorted(tuple(r) for r in after if not leaked(r["text"], items)) and len(rows) < len(after)

    docs, after = kept(STAGE["source_mixing"](spark, docs, SF))
    times = mixed_times([(r["doc_id"], r["text"], r["source"]) for r in rows])
    assert Counter(map(tuple, after)) == Counter({tuple(r): times[r["doc_id"]] for r in rows})

    final = STAGE["sharding"](spark, docs, SF).collect()
    assert Counter(tuple(r[c] for c in columns) for r in final) == Counter(map(tuple, after))
    counts = Counter(r["shard"] for r in final)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    assert all(sorted(r["slot"] for r in final if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    assert all((r["size"], r["text_crc32"]) == (len(r["text"].encode()) + 1, zlib.crc32(r["text"].encode())) for r in final)


@pytest.mark.parametrize("case", ["no documents", "no items and labels", "odd rows"])
def test_odd_tables_pass_all_stages(spark, tmp_path, case):
    schema = "doc_id long, text string, source string, score double, size string, row string, shard int, `Key` int"
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "a b c d e f", "s", 1.0, "x", "r", 1, 1)] * 3 + [(None, None, None, None, None, None, None, None)] * 2 + [(2, "", "s", 0.5, "y", "q", 2, 2), (None, "alpha beta gamma", None, 0.5, "y", "q", 2, 2), (3, long, "t", 0.1, "z", "p", 3, 3)]
    rows += [(i, f"plain text number {i} of a source that is like no other {i * i}", "u", 0.0, "v", "o", 0, 0) for i in range(10, 40)]
    docs = spark.createDataFrame([] if case == "no documents" else rows, schema)
    items = [] if case == "no items and labels" else [(1, "nothing of this is anywhere in it at all my friend")]
    labels = [] if case == "no items and labels" else [(i, i % 2, 0) for i in range(10, 40)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert docs.columns == [c.strip("`") for c in ["doc_id", "text", "source", "score", "size", "row", "shard", "Key"]], name
    got = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert got.count() == docs.count() and got.where("slot IS NULL").count() == 0
    if case != "no documents":
        ids = {r["doc_id"] for r in docs.where("text <> ''").select(F.col("doc_id")).collect()}
        assert ids == {1, 3, None, *range(10, 40)}
