"""Line dedup, fill-in-middle and turn repair against brute force, on rows with nulls, repeats, ties, long texts and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heirloom.llm import fill_middle, line_dedup, turn_repair


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- lines


def lines_by_hand(docs, least=40, most=5):
    strip, low = " \t\n\v\f\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = [(k, (t or "").split("\n")) for k, t in docs]
    keys = [[x.strip(strip).translate(low) for x in lines] for _, lines in split]
    held = {}
    for (k, _), ks in zip(split, keys, strict=True):
        for key in set(ks):
            if len(key) >= least:
                held.setdefault(key, []).append(k)
    last = {key: max((x for x in ids if x is not None), default=None) for key, ids in held.items() if len(ids) >= most}
    out = []
    for (k, lines), ks in zip(split, keys, strict=True):
        kept = [x for x, key in zip(lines, ks, strict=True) if key not in last or last[key] == k]
        out.append((k, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [27, 15])
def test_lines(spark, bits):
    rng = random.Random(5)
    pool = [" ".join(rng.choice(["Añb", "cd", "EF", "ghi", "日本", "x"]) for _ in range(rng.randrange(3, 30))) for _ in range(60)]
    pool += ["y" * 39, "Y" * 40, "é" * 40, "é" * 39, "", " ", "\t\r"]
    docs = [(i, "\n".join(rng.choice(["", "  ", "\t"]) + rng.choice(pool) + rng.choice(["", " \r", "\v"]) for _ in range(rng.randrange(0, 9)))) for i in range(150)]
    docs += [(3, docs[3][1]), (3, "other\n" + pool[0]), (None, pool[1]), (None, pool[1]), (None, None), (200, None), (201, ""), (202, "\n"), (203, "\n".join(pool * 400)), (204, "z" * 300_000)]
    docs += [(k, "n" * 50) for k in [None] * 6]
    frame = spark.createDataFrame([(k, t, 1, "c") for k, t in docs], "doc_id long, text string, n_lines int, key string").repartition(7)
    got = line_dedup.drop_repeated_lines(frame, bits=bits)
    assert sorted(((r["doc_id"], r["n_lines"], len(r["dropped"]), r["kept_sha256"]) for r in got.collect()), key=repr) == lines_by_hand(docs)
    text = {(r["doc_id"], r["kept_sha256"]): r["kept"] for r in got.where("kept IS NOT NULL").collect()}
    assert text and all(sha(t) == s for (_, s), t in text.items())


def test_lines_of_no_table(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_filters_keep_every_repeat():
    """A key that two documents hold, in one task or two, is in the second filter; few others are."""
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 20000, dtype=np.uint64)
    at = line_dedup.places(hashes, 20)
    table = np.zeros(1 << 17, np.uint8)
    line_dedup.put(table, at[:5000].ravel())
    assert line_dedup.holds(table, at[:5000]).all()
    assert line_dedup.holds(table, at[5000:]).mean() < 0.01


# ---- fill-in-middle


def filled_by_hand(k, t):
    t = t or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    n = len(tokens)
    h = [int(sha(f"1:{'' if k is None else k}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (k, n, "plain", None, None, sha(t), sha(t))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(tokens[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    form, out = ("spm", f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < 20 else ("psm", f"<P>{pre}<S>{suf}<M>{mid}")
    return (k, n, form, len(pre), len(mid), sha(out), sha(t))


def test_fill_middle(spark):
    rng = random.Random(6)
    docs = [(i, "".join(rng.choice(["ab", "Z", " ", "é", "日", "\n", "<", "P>", "1", "𝒳", "\x00"]) for _ in range(rng.randrange(0, 40)))) for i in range(400)]
    docs += [(i, "same text of many") for i in range(500, 620)] + [(7, docs[7][1]), (7, "other"), (None, "null key"), (None, None), (None, "same text of many"), (900, None), (901, ""), (902, "a<P>b"), (903, "q" * 200_000 + "\n" + "é " * 90_000), (904, "<"), (905, "x<S<M")]
    frame = spark.createDataFrame([(k, t, "c", 1) for k, t in docs], "doc_id long, text string, form string, t int").repartition(5)
    made = fill_middle.fill_middle(frame).withColumns({"o": F.sha2("output", 256), "r": F.sha2(fill_middle.restored("output", "form"), 256)})
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["o"], r["r"]) for r in made.collect()), key=repr)
    assert got == sorted((filled_by_hand(k, t) for k, t in docs), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_move_once(spark):
    """Both branches read one exchange of texts; what is joined back has none of its own."""
    plan = fill_middle.fill_middle(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(t#") <= 2 and "digest" in plan


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in ((1, 1), (1, 9000), (50, 50), (1000, 1_000_000), (4000, 5000)):
        values = np.sort(rng.choice(np.arange(1, top + 1), n, replace=False))
        width, low, high = fill_middle.packed(values)
        assert [fill_middle.selected(width, low, high, i) for i in range(n)] == values.tolist()
        assert len(low) + len(high) <= (n * (3 + max(0, int(np.ceil(np.log2(top / n)))))) // 8 + 2
    assert fill_middle.packed(np.zeros(0, np.int64)) == (0, b"", b"")


# ---- turns


def step(state, initial):
    return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, initial))


def cheapest(initials, faults):
    """Least (cost, letters, roles) by trying all ways, cheapest first for each row and state."""
    front = {0: (0, "", "")}

    def insert(front):
        for _ in range(4):
            for s, (c, w, r) in list(front.items()):
                for i in "ua":
                    t = step(s, i)
                    if t is not None and (t not in front or (c + 3, w + "I") < front[t][:2]):
                        front[t] = (c + 3, w + "I", r + i)
        return front

    for initial, fault in zip(initials, faults, strict=True):
        front, after = insert(front), {}
        for s, (c, w, r) in front.items():
            ways = [(s, c + 4, w + "D", r)]
            if fault not in (1, 2):
                more = 3 if fault == 3 else 0
                ways += [(step(s, initial), c + more, w + "K", r + initial)] + [(step(s, i), c + 3 + more, w + "R", r + i) for i in "ua"]
            for t, *new in ways:
                if t is not None and (t not in after or tuple(new[:2]) < after[t][:2]):
                    after[t] = tuple(new)
        front = after
    front = insert(front)
    return min(front[s] for s in (0, 3) if s in front)


def test_repairs_are_cheapest_and_least():
    for n in range(5):
        for initials in itertools.product("suax", repeat=n):
            for faults in itertools.product((0, 1, 3) if n < 4 else (0, 3), repeat=n):
                edits = turn_repair.repairs("".join(initials), bytes(faults))
                assert len(edits) == n + 1
                letters = re.sub("[ua]", "", "".join(edits))
                cost, want, _ = cheapest(initials, faults)
                assert (turn_repair.distances("".join(initials), bytes(faults))[0], letters) == (cost, want), (initials, faults)


def repaired_by_hand(rows):
    """rows: turn, role and text of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        solid = re.sub(r"[ \t-\r]+\Z", "", text)
        faults.append(1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0)
        seen.add((role, text))
    cost, letters, roles = cheapest([r[1][:1] for r in rows], faults)
    out, at, left = [], 0, iter(roles)
    for x in letters:
        role = {"u": "user", "a": "assistant"}.get(next(left) if x in "RIK" else "")
        if x == "I":
            out.append(f"{role}:")
        else:
            if x != "D":
                out.append(f"{role if x == 'R' else rows[at][1]}:{rows[at][2]}")
            at += 1
    turns = {r[0] for r in rows} - {None}
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(i) for i in (1, 2, 3)), sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, sha("\n".join(out)))


def test_conversations(spark):
    rng = random.Random(8)
    texts = ["Yes.", "No", "no end \n", "ok! \t", "", " \r\n", "What?", "a. b", None, "é日."]
    rows = []
    for c in [*range(300), None]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([t, t, t, t + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    rows += rows[:20] + [(1000, t, ("user", "assistant")[t % 2], f"turn {t}." if t % 7 else "x" * 100_000) for t in range(600)]
    frame = spark.createDataFrame([(*r, 1, "c") for r in rows], "conv_id long, turn long, role string, text string, seq int, k string").repartition(6)
    told = lambda x: " " if x is None else str(x)
    convs = {}
    for c, t, role, text in rows:
        role, text, mine = told(role), told(text), convs.setdefault(c, [])
        kind = zlib.crc32(f"{told(c)}:{told(t)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    want = sorted(((c, *(repaired_by_hand(x) if x else (0, 0, 0, 0, 0, 0, "", sha("")))) for c, x in convs.items()), key=repr)
    got = turn_repair.repaired_conversations(frame)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert any(w[1:] == (0, 0, 0, 0, 0, 0, "", sha("")) for w in want)
    assert turn_repair.repaired_conversations(frame.limit(0)).count() == 0


def test_steps_give_the_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", "And"), (1, 2, "user", "And")], "k long, turn long, role string, text string")
    got = [tuple(r) for r in turn_repair.repair_steps(rows).orderBy("seq", "step").select("edit", "fault", "role", "text").collect()]
    assert got == [("I", None, "user", ""), ("K", 0, "assistant", "Hi."), ("D", 3, None, None), ("D", 2, None, None)]
