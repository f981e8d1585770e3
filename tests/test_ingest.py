"""Character sets, lines, levels, and a whole file through the passes and the command line."""

import codecs
import random
import re

import pytest
from pyspark.sql import functions as F

from heirloom import cli
from heirloom.operators.hierarchy import with_parents, with_records, with_tree
from heirloom.plans import dates, ingest, inspect, kinship
from heirloom.sources.encodings import decode, hint_of
from heirloom.sources import gedcom
from heirloom.sources.gedcom import parse_lines, read_files, read_lines, split_lines
from heirloom.sources.progress import watched
from heirloom.sources.store import Store, settle


@pytest.mark.parametrize(("data", "text", "kind", "bad"), [
    (b"\xef\xbb\xbf0 HEAD", "0 HEAD", "UTF-8", 0), (b"a\xe2\x82b\xff", "a��b�", "UTF-8", 3), (b"\xff\xfea\x00\x00\xd8b\x00", "a�b", "UTF-16", 1), (b"\xfe\xff\x00a\x00", "a�", "UTF-16", 1),
    (b"1 CHAR ANSEL\nJos\xe2e \xa1\x80\xe1", "1 CHAR ANSEL\nJosé Ł��̀", "ANSEL", 2), (b"1 CHAR ANSI\n\x80\x81\xe9", "1 CHAR ANSI\n€�é", "CP1252", 1), (b"", "", "UTF-8", 0),
])
def test_decoding(data, text, kind, bad):
    assert decode(data, hint_of(data)) == (text, kind, bad)


def test_lines(spark):
    text = "0 HEAD\r\n1 note  two  blanks\r0 @I1@ INDI\nbad line\n1 NAME\n\n2"
    rows = parse_lines(split_lines(spark.createDataFrame([("﻿" + text + "\n",)], "text string"))).orderBy("line_no").collect()
    assert [(r["level"], r["xref"], r["tag"], r["value"]) for r in rows] == [
        (0, None, "HEAD", ""), (1, None, "NOTE", " two  blanks"), (0, "@I1@", "INDI", ""), (0, None, "_UNPARSED", "bad line"), (1, None, "NAME", ""), (0, None, "_UNPARSED", ""), (0, None, "_UNPARSED", "2"),
    ]


def test_parents_equal_a_stack(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for file in range(40):
        stack = {}
        for n in range(1, 40):
            level = rng.choice([0, 1, 1, 2, 2, 3, 5])
            rows.append((file, n, level, None))
            want[file, n] = stack.get(level - 1) if level else None
            stack = {k: v for k, v in stack.items() if k < level} | {level: n}
    lines = spark.createDataFrame(rows, "file int, line_no long, level int, xref string")
    got = with_parents(with_records(lines, ["file"], width=7), ["file", "record_no"])
    assert {(r["file"], r["line_no"]): r["parent_line"] for r in got.collect()} == want


def test_tree_in_one_pass_equals_a_stack(spark):
    """Records and parents, also where a bucket of line numbers begins inside a record, without a first record, with levels that are skipped or too large."""
    rng = random.Random(6)
    for start in (0, 1):
        rows, want, stack, record, xref = [], {}, {}, 0, ""
        for n in range(1, 400):
            level = start if n == 1 else rng.choice([0] + [1, 1, 2, 2, 3, 5, None] * 4)
            tag, own = f"T{n % 5}", f"@{n}@" if n % 3 else None
            rows.append((n, level, own, tag))
            if level == 0:
                record, xref = record + 1, own or ""
            up = stack.get(level - 1) if level else None
            want[n] = (record, xref, *(up or (None, None)))
            if level is not None:
                stack = {k: v for k, v in stack.items() if k < level} | {level: (n, tag)}
        lines = spark.createDataFrame(rows, "line_no long, level int, xref string, tag string")
        got = {r["line_no"]: (r["record_no"], r["record_xref"], r["parent_line"], r["parent_tag"]) for r in with_tree(lines, width=7).collect()}
        assert got == want and with_tree(lines.limit(0)).count() == 0


def test_lines_of_a_table_of_one_file_are_spread(spark):
    """F11 to F14: however few tasks read the customers, their lines are parsed by all."""
    from heirloom.queries import tree_lines

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n = [r["count"] for r in tree_lines(spark, "/root/testdata/sf0.01").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(n) == 4 and max(n) < sum(n) / 2


FILE = """0 HEAD
1 CHAR UTF-8
0 @I1@ INDI
1 NAME Ada Mae /Vale/
2 CONC  Jr
1 SEX F
1 BIRT
2 DATE 1850
2 PLAC Salem,
3 CONC  OR
1 DEAT Y
0 @I2@ INDI
1 NAME Bo /Reed/
2 GIVN
1 BIRT
2 DATE MAR 1945
0 @I3@ INDI
1 NAME Cy
1 FAMC @F1@
2 PEDI adop
0 @I3@ INDI
1 NAME Twice
0 INDI
1 NAME No One
0 @F1@ FAM
1 HUSB @I2@
1 WIFE @I1@
1 CHIL @I3@
1 CHIL @I3@
1 CHIL @I9@
1 MARR
2 DATE 1870
2 SOUR @S1@
2 SOUR @S2@
1 EVEN
2 TYPE Moved
2 NOTE one
3 CONT two
oops
1 LOST line
0 TRLR
"""


def test_whole_file(spark, tmp_path, capsys):
    (tmp_path / "a.ged").write_text(FILE, encoding="utf-8")
    argv = ["--db", str(tmp_path / "tree"), "--gedcom", str(tmp_path / "a.ged")]
    assert cli.main(["all", *argv], spark) == 0
    store = Store(spark, f"file://{tmp_path}/tree")
    people = {r["gedcom_xref"]: r for r in store.read("individuals").collect()}
    assert [people[x]["id"] for x in ("@I1@", "@I2@", "@I3@")] == [1, 2, 3] and len(people) == 3
    assert (people["@I1@"]["name_given"], people["@I1@"]["name_surname"], people["@I1@"]["name_full"]) == ("Ada Mae", "Vale", "Ada Mae /Vale/ Jr")
    assert people["@I2@"]["name_given"] is None and people["@I2@"]["is_living"] == 1 and people["@I1@"]["is_living"] == 0
    assert (people["@I1@"]["birth_start"], people["@I1@"]["lifespan_src"]) == ("1850-01-01", "stated")
    fam = store.read("families").first()
    assert (fam["husband_id"], fam["wife_id"], fam["marriage_start"]) == (2, 1, "1870-01-01")
    assert [tuple(r) for r in store.read("family_children").collect()] == [(1, 3, "adopted")]
    ev = {r["event_type"]: r for r in store.read("events").collect()}
    assert ev["BIRT"] is not None and ev["MARR"]["source_count"] == 2 and ev["Moved"]["note"] == "one\ntwo"
    assert {r["place_raw"] for r in store.read("places").collect()} == {"Salem, OR"}
    raw = store.read("raw_records")
    assert raw.where("tag = 'LOST'").first()["parent_id"] == raw.where("tag = '_UNPARSED'").first()["id"]
    assert {(r["from_id"], r["to_id"], r["edge_type"], r["weight"]) for r in store.read("kinship_edges").collect()} == {
        (1, 2, "spouse", 1.0), (2, 1, "spouse", 1.0), (1, 3, "parent", 2.0), (2, 3, "parent", 2.0), (3, 1, "child", 2.0), (3, 2, "child", 2.0),
    }
    assert kinship.summary(store, 3, 1) == "connected by social family links, 1 edge"
    assert tuple(inspect.kinship_integrity(store.read("kinship_edges"), store.read("kinship_distance")).first()) == (0, 0, 0)
    with pytest.raises(ValueError, match="unknown"):
        kinship.summary(store, 1, 99)
    assert store.migrate() is False
    store.rebuild_derived()
    assert store.read("individuals").count() == 0
    with pytest.raises(SystemExit):
        cli.main(["rumours"], spark)
    for command in ("presence", "candidates", "score", "export"):
        assert cli.main([command, *argv], spark) == 0
    assert (tmp_path / "export" / "manifest").is_dir()
    assert "config_hash=" in capsys.readouterr().out


def test_empty_file(spark, tmp_path):
    (tmp_path / "e.ged").write_bytes(b"")
    assert cli.main(["ingest", "--db", str(tmp_path / "t"), "--gedcom", str(tmp_path / "e.ged")], spark) == 0
    assert Store(spark, f"file://{tmp_path}/t").read("individuals").agg(F.count(F.lit(1))).first()[0] == 0


def test_one_file_a_store(spark, tmp_path):
    """Two files have the same xrefs and line numbers; together they are refused, and nothing is written."""
    for name, person in (("a", "Ann /A/"), ("b", "Bob /B/")):
        (tmp_path / f"{name}.ged").write_text(f"0 HEAD\n0 @I1@ INDI\n1 NAME {person}\n0 TRLR\n")
    store = Store(spark, f"{tmp_path}/db")
    with pytest.raises(ValueError, match="more than one file"):
        ingest.run(spark, store, str(tmp_path / "*.ged"))
    assert store.read("individuals").count() == 0
    assert ingest.run(spark, store, str(tmp_path / "a.ged"))["individuals"] == 1


ENDS = ["\n", "\r\n", "\r", "\n\n", "\n\r", "\r\r\n"]


def odd_files():
    """Files in every encoding with line ends of all kinds, characters that hold the byte of a line feed, and bytes without meaning."""
    rng = random.Random(1)
    text = "".join("".join(rng.choice("ab ÿé日ਅĊਊ\U0001f600") for _ in range(rng.randrange(0, 12))) + rng.choice(ENDS) for _ in range(60))
    old = b"".join(bytes(rng.choice([97, 32, 0xE1, 0xE2, 0xA1, 0xFF, 101]) for _ in range(7)) + rng.choice(ENDS).encode() for _ in range(60))
    return {
        "utf8": codecs.BOM_UTF8 + text.encode() + b"\xe3\x81\n\xff\r", "plain": text.encode() + b"\r\n", "le": codecs.BOM_UTF16_LE + text.encode("utf-16-le") + b"\x05\x0a", "le2": codecs.BOM_UTF16_LE + (text + "\n\n").encode("utf-16-le"),
        "be": codecs.BOM_UTF16_BE + text.encode("utf-16-be") + b"\x01\x0a", "be2": codecs.BOM_UTF16_BE + (text + "\n\n").encode("utf-16-be") + b"\x00", "ansel": b"0 HEAD\n1 CHAR ANSEL\n" + old + b"e\xe1", "ansel2": b"0 HEAD\n1 CHAR ANSEL\n" + old + b"e\xe1\n",
        "cp1252": b"0 HEAD\r\n1 CHAR ANSI\r\n" + bytes(range(256)) * 2, "empty": b"", "mark": codecs.BOM_UTF16_BE, "feed": b"\n",
    }


@pytest.mark.parametrize("name", list(odd_files()))
def test_ranges_give_the_lines_of_the_whole(spark, tmp_path, monkeypatch, name):
    data = odd_files()[name]
    path = tmp_path / "a.ged"
    path.write_bytes(data)
    whole = read_files(spark, str(path)).collect()
    want = [(r["line_no"], r["raw"]) for r in split_lines(read_files(spark, str(path))).orderBy("line_no").collect()]
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before, ranges = [spark.conf.get(n) for n in names], []

    def cut_small(df, name):
        """Read the file itself, and nothing else, in 64 ranges."""
        if name != "pieces":
            return settle(df, name)
        try:
            for n, v in zip(names, (str(max(1, len(data) // 64)), "1"), strict=True):
                spark.conf.set(n, v)
            out = settle(df, name)
        finally:
            for n, v in zip(names, before, strict=True):
                spark.conf.set(n, v)
        ranges.append(out.select("block").distinct().count())
        return out.coalesce(4)

    monkeypatch.setattr(gedcom, "settle", cut_small)
    lines, kind = read_lines(spark, str(path))
    got = lines.orderBy("line_no").collect()
    assert len(data) < 640 or ranges[0] > 30
    assert [(r["line_no"], r["raw"]) for r in got] == want
    assert (kind, sum(r["bad"] for r in got)) == (whole[0]["encoding"], whole[0]["unmappable_bytes"]) if whole else not got


def test_warnings_progress_and_tables(spark, tmp_path, caplog):
    (tmp_path / "a.ged").write_text(FILE, encoding="utf-8")
    store = Store(spark, f"file://{tmp_path}/tree")
    store.migrate()
    said = []
    with caplog.at_level("WARNING"), watched(spark, "ingest", said.append, every=0.01):
        done = ingest.run(spark, store, str(tmp_path / "a.ged"))
        dates.run(store)
    assert done["unparsed_lines"] == 1 and done["individuals_with_no_events"] == store.read("people_without_events").count() == 1
    assert {r["tag"]: r["n_lines"] for r in store.read("tag_counts").collect()}["CHIL"] == 3 and done["tags"] == store.read("tag_counts").count()
    assert ["1 lines of the file" in m or "have no date" in m for m in caplog.messages] == [True, True]
    assert said[0] == "[ingest] started" and any(re.fullmatch(r"\[ingest\] \d+/\d+", x) for x in said)
