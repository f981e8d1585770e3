"""Written dates and the pass over events."""

import pytest
from pyspark.sql import functions as F

from heirloom.functions.dates import normalize_date
from heirloom.plans import dates

FORMS = [
    ("14 MAY 1861", "1861-05-14", "1861-05-14", "day", None, "ok"),
    ("feb 1904", "1904-02-01", "1904-02-29", "month", None, "ok"),
    ("1811", "1811-01-01", "1811-12-31", "year", None, "ok"),
    ("1811/12", "1811-01-01", "1812-12-31", "year", None, "ok"),
    ("ABT 12 JAN 1850", "1845-01-01", "1855-12-31", "year", "ABT", "ok"),
    ("Cal. 1850", "1848-01-01", "1852-12-31", "year", "CAL", "ok"),
    ("EST MAY 1840", "1830-01-01", "1850-12-31", "year", "EST", "ok"),
    ("ABT 3", "0001-01-01", "0008-12-31", "year", "ABT", "ok"),
    ("BEF 1790", "1750-01-01", "1789-12-31", "inferred", "BEF", "ok"),
    ("AFT JUN 1801", "1801-07-01", "1841-12-31", "inferred", "AFT", "ok"),
    ("Bet. 1801 - 1804", "1801-01-01", "1804-12-31", "range", "BET", "ok"),
    ("BET MAR 1801 AND 2 APR 1804", "1801-03-01", "1804-04-02", "range", "BET", "ok"),
    ("FROM 1801 TO 1804", "1801-01-01", "1804-12-31", "range", "FROM TO", "ok"),
    ("1740", "1739-12-21", "1741-01-11", "year", None, "ok"),
    ("BET 1740 AND 1741", "1740-01-01", "1741-12-31", "range", "BET", "ok"),
    ("@#DJULIAN@ 1740", "1740-01-01", "1740-12-31", "year", "@#DJULIAN@", "partial"),
    ("@#DGREGORIAN@ ABT 1740", "1735-01-01", "1745-12-31", "year", "@#DGREGORIAN@ ABT", "ok"),
    ("1", "0000-12-21", "0002-01-11", "year", None, "ok"),
    ("AFT 9999", "10000-01-01", "10039-12-31", "inferred", "AFT", "ok"),
]
NONE = [
    (None, "empty"), ("   ", "empty"), ("31 APR 1872", "unrecognized date"), ("29 FEB 1900", "unrecognized date"), ("0000", "unrecognized date"), ("MARCH 1872", "unrecognized date"), ("1799/00", "unrecognized date"),
    ("FROM 1801", "unrecognized date"), ("1872 or so", "unrecognized date"), ("BET 1804 AND 1801", "invalid range"), ("ABT spring", "invalid qualified date"), ("BEF then", "invalid open date"), ("BEF 1", "outside lifespan"),
    ("@#DHEBREW@ 5 TSH 5600", "unsupported calendar @#DHEBREW@"), ("3 JAN 1700/01", "unrecognized date"),
]


def test_forms(spark):
    df = spark.createDataFrame([(f[0],) for f in FORMS] + [(n[0],) for n in NONE], "raw string")
    got = {r["raw"]: r["n"] for r in df.select("raw", normalize_date(F.col("raw")).alias("n")).collect()}
    for raw, *want in FORMS:
        assert list(got[raw])[:5] == want, raw
    for raw, reason in NONE:
        assert got[raw]["date_start"] is None and got[raw]["reason"] == reason, raw


@pytest.mark.parametrize(("raw", "low", "high", "start", "end"), [("BEF 1872", "1830-02-03", None, "1830-02-03", "1871-12-31"), ("AFT 1872", None, "1900-05-06", "1873-01-01", "1900-05-06"), ("AFT 1901", None, "1900-05-06", None, None)])
def test_clamped(spark, raw, low, high, start, end):
    df = spark.createDataFrame([(raw, low, high)], "raw string, low string, high string")
    n = df.select(normalize_date(F.col("raw"), F.col("low"), F.col("high")).alias("n")).first()["n"]
    assert (n["date_start"], n["date_end"]) == (start, end)
    assert n["precision"] == ("range" if start else None)


def test_pass_is_repeatable_and_last_marriage_wins(spark):
    rows = [
        (1, "individual", 1, "BIRT", "1850"), (2, "individual", 1, "BURI", "1910"), (3, "individual", 1, "RESI", "AFT 1880"), (4, "individual", 1, "DEAT", "BEF 1909"), (5, "family", 7, "MARR", "1871"),
        (6, "family", 7, "MARR", "MAY 1870"), (7, "family", 7, "MARR", "never"),
    ]
    ev = spark.createDataFrame(rows, "id long, subject_type string, subject_id long, event_type string, date_raw string")
    d = dates.dated_events(ev)
    got = {r["event_id"]: (r["date_start"], r["date_end"], r["precision"]) for r in dates.event_dates(d).collect()}
    # the burial is no bound, and the open death has none of its own
    assert got[3] == ("1881-01-01", "1920-12-31", "inferred")
    assert got[4] == ("1850-01-01", "1908-12-31", "range")
    assert 7 not in got
    life = dates.lifespans(spark.createDataFrame([(1,), (2,)], "id long"), d).orderBy("id").collect()
    assert (life[0]["birth_start"], life[0]["death_end"], life[0]["lifespan_src"]) == ("1850-01-01", "1910-12-31", "stated")
    assert life[1]["lifespan_src"] == "unknown"
    fam = dates.marriages(spark.createDataFrame([(7, "x")], "id long, y string"), d).first()
    assert (fam["marriage_start"], fam["marriage_end"]) == ("1870-05-01", "1870-05-31")
