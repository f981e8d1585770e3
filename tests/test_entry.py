"""The driver's contract, and queries against their SQL."""

import ast
import glob
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from heirloom.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
FAST = ["date_calendars", "place_stats", "place_normalize", "place_resolve", "guarded_upsert", "line_parse", "line_split", "level_parent", "conc_cont", "decode_files", "kin_edges", "edge_integrity", "kinship_integrity", "row_counts", "date_sample", "lifespan_violations", "date_normalize", "date_widen", "relationship_labels", "interval_islands", "presence_intervals", "presence_evidence", "overlap_join", "close_kin", "same_household", "scored_candidates", "suppression_log", "best_of_people", "best_candidates", "export_manifest", "sniffed_encodings", "decode_cp1252", "decode_ansel", "record_bounds", "last_write", "merged_places", "context_lookup"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(records):
    return sorted(tuple("" if v is None else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in records)


def test_contract(spark):
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["place_raw", "occurrence_count", "affected_individuals"]


@pytest.mark.parametrize("name", FAST)
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert rows(map(tuple, df.select(*cols).collect())) == rows(duck.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall())


def test_layers():
    """Only the entry knows the corpus operators, and functions and operators reach no file, clock, network or environment."""
    root = Path(entry.__file__).parent
    for p in [*root.glob("heirloom/*.py"), *(q for d in ("functions", "operators", "plans", "sources") for q in root.glob(f"heirloom/{d}/*.py"))]:
        names = set()
        for node in ast.walk(ast.parse(p.read_text())):
            if isinstance(node, ast.Import):
                names |= {a.name for a in node.names}
            elif isinstance(node, ast.ImportFrom):
                names |= {node.module, *(f"{node.module}.{a.name}" for a in node.names)}
            elif isinstance(node, ast.Call) and p.parent.name in ("functions", "operators"):
                assert getattr(node.func, "id", "") not in ("open", "print", "input"), p
        assert not any(n.startswith("heirloom.llm") for n in names), p
        if p.parent.name in ("functions", "operators"):
            assert not {n.split(".")[0] for n in names} & {"os", "io", "pathlib", "time", "datetime", "random", "socket", "urllib", "subprocess", "tempfile"}, p
            assert not any(n.startswith("heirloom.plans") or n.startswith("heirloom.sources") and p.parent.name == "functions" for n in names), p
