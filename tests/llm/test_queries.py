"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from heirloom.llm.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def rows(records):
    return sorted(tuple("" if v is None else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in records)


@pytest.mark.parametrize("name", ["op3_url_rules", "op4_curriculum_mix", "op5_forest_join", "op6_metric_join", "op7_winnowing", "op9_preference_format", "op10_suffix_sort", "op11_line_dedup", "op12_fill_in_middle"])
def test_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert rows(map(tuple, df.select(*cols).collect())) == rows(con.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall())


def test_url_rules_with_line_ends(spark, tmp_path):
    """The registered rules on urls with line ends of all kinds in host and path, against their SQL."""
    ends = ["", "\n", "\r", "\r\n", "\u2028", "\u0085"]
    urls = [f"http://a{e}b.{t}{f}/{lang}/{e}x" for e in ends for f in ("", "\n") for t in ("com", "net", "org") for lang in ("en", "de", "es")] + ["http://e\nexample.com/en/7", "http://x.example.com/en/7\n", "http://com/e\nn/", "http://x.com/en/" + "y\n" * 100_000]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = QUERIES["op3_url_rules"](spark, str(tmp_path))
    cols = sorted(df.columns)
    got = rows(map(tuple, df.select(*cols).collect()))
    assert got == rows(con.sql(f"SELECT {', '.join(cols)} FROM ({SQL['op3_url_rules']})").fetchall()) and sum("block" in r for r in got) >= 18


def test_url_rules_of_the_contract(spark, tmp_path):
    """Each rule's word as the contract lists it, on urls that each rule decides, alone or against a shorter one."""
    want = {
        "http://x.com/en/6": ("com/en/", "block"), "http://example.com/en/72": ("example.com/en/7", "allow"), "http://x.net/de/8": ("net/de/", "allow"), "http://NET/de/": ("net/de/", "allow"),
        "http://a.example.net/de/81": ("example.net/de/8", "block"), "http://example.net/de/7": ("net/de/", "allow"), "http://x.org/es/": ("org/es/", "block"), "http://x.net/en/": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op3_url_rules"](spark, str(tmp_path)).orderBy("page_id").collect()
    assert {u: (r["rule"], r["verdict"]) for u, r in zip(want, got, strict=True)} == want


def test_very_long_texts(spark, tmp_path):
    """Long texts of one line and of many beside short, null and empty ones, through operators on documents and conversations, against their SQL."""
    long = "\n".join(" ".join(f"w{i * j % 997}" for j in range(1, 40)) for i in range(400))
    docs = [(1, long, "a"), (2, "short text", "a"), (3, None, "b"), (4, "", None), (5, long.replace("\n", " "), "b")]
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", long), (2, 0, "user", "q"), (2, 1, "assistant", long + "!"), (3, 0, "user", None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("op4_curriculum_mix", "op9_preference_format", "op11_line_dedup", "op12_fill_in_middle"):
        df = QUERIES[name](spark, str(tmp_path))
        cols = sorted(df.columns)
        quoted = ", ".join(f'"{c}"' for c in cols)
        assert rows(map(tuple, df.select(*cols).collect())) == rows(con.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall()), name


def test_all():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13
    assert set(SQL) <= set(QUERIES)


def test_preferences_with_shared_openings(spark, tmp_path):
    turns = [
        (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (1, 3, "assistant", "long"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (2, 2, "user", "less"), (2, 3, "assistant", "short"),
        (3, 0, "user", "r"), (3, 1, "assistant", "x"), (4, 0, "user", "r"), (4, 1, "assistant", "y"), (5, 0, "user", "s"), (5, 1, "assistant", "z"), (6, 0, "user", "t"), (6, 1, "assistant", "same"), (7, 0, "user", "t"), (7, 1, "assistant", "same"),
    ]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    df = QUERIES["op9_preference_format"](spark, str(tmp_path))
    got = df.collect()
    cols = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert rows(map(tuple, df.select(*cols).collect())) == rows(con.sql(f"SELECT {quoted} FROM ({SQL['op9_preference_format']})").fetchall())
    assert sorted(r["status"] for r in got) == ["identical", "pair", "pair", "single"]
    assert sorted(r["n_common"] for r in got if r["status"] == "pair") == [1, 2]
    assert all(r["chosen_loss"] and r["rejected_loss"] and r["chosen"] != r["rejected"] for r in got if r["status"] == "pair")
