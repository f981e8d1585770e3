"""Place texts, cached answers, the guarded table and the review queue."""

import pytest
from pyspark.sql import functions as F

from heirloom.config import load_config
from heirloom.functions.places import normalize_place, parse_resolution, qualified_confidence, qualifier_of, resolution_json, tier_radius
from heirloom.plans import places
from heirloom.operators.ids import sorted_ids
from heirloom.sources.aliases import AliasError, read_aliases
from heirloom.sources.geocoder import answer, build_request
from heirloom.sources.store import Store, artifact_path

TEXTS = [
    ("near Salem, OR", "Salem, Oregon", "near"), ("Prob. Bath Co, ky", "Bath County, Kentucky", "Prob."), ("Bath  Cnty. , VA, USA", "Bath County, Virginia, USA", None), ("Scotland", "Scotland", None), ("", "", None),
    (", of Kent", "of Kent", None), ("Costa, Cocoa", "Costa, Cocoa", None), ("In, La", "Indiana, Louisiana", None), ("of Kent", "Kent", "of"), ("co", "Colorado", None),
]


def test_normal_forms(spark):
    df = spark.createDataFrame([(t[0],) for t in TEXTS], "raw string")
    got = {r["raw"]: (r["n"], r["q"]) for r in df.select("raw", normalize_place(F.col("raw")).alias("n"), qualifier_of(F.col("raw")).alias("q")).collect()}
    for raw, normalized, qualifier in TEXTS:
        assert got[raw] == (normalized, qualifier), raw


def test_cached_answers(spark):
    good = '{"normalized":"A","lat":1.5,"lon":null,"precisionTier":"region","admin1":null,"admin2":null,"country":null,"confidence":0.5,"source":"s"}'
    bad = ["not json", '{"normalized":"A"}', good.replace("0.5", '"0.5"'), good.replace("region", "galaxy"), good.replace('"A"', "5")]
    df = spark.createDataFrame([(x,) for x in [good, *bad]], "j string").select("j", parse_resolution(F.col("j")).alias("r"))
    rows = df.select("r", resolution_json(F.col("r")).alias("again")).collect()
    assert rows[0]["r"]["lat"] == 1.5 and rows[0]["r"]["lon"] is None and rows[0]["again"] == good
    assert all(r["r"] is None for r in rows[1:])


def test_tiers_and_confidence(spark):
    row = spark.range(1).select(*[tier_radius(F.lit(t)).alias(t) for t in ("address", "locality", "district", "region", "country", "unknown")], qualified_confidence(F.lit(0.9), 0.4).alias("c")).first()
    assert list(row)[:6] == [1.0, 10.0, 50.0, 250.0, 0.0, None]
    assert row["c"] == pytest.approx(0.54)


def test_pass(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/tree")
    store.migrate()
    raws = ["Salem, OR", "near Salem, OR", "Nowhere", "Kept", 'Odd "x", y']
    store.write("events", spark.createDataFrame([(i + 1, "individual", i, "RESI", None, r, 0, None, i) for i, r in enumerate(raws + ["Nowhere"])], store.read("events").schema))
    human = spark.createDataFrame([(1, "Kept", "K", 1.0, 2.0, 3.0, "locality", None, None, None, "human", 1.0, "rejected"), (2, "Orphan", "O", None, None, None, "unknown", None, None, None, "none", 0.0, "auto")], store.read("places").schema)
    store.write("places", human)
    calls = f"{tmp_path}/calls"

    def provider(query):
        with open(calls, "a") as f:
            f.write(query + "\n")
        if query == "Salem, Oregon":
            return {"normalized": query, "lat": 44.9, "lon": -123.0, "precisionTier": "locality", "admin1": None, "admin2": None, "country": None, "confidence": 0.9, "source": "fixture"}
        return {"normalized": query, "lat": None, "lon": None, "precisionTier": "unknown", "admin1": None, "admin2": None, "country": None, "confidence": 0.0, "source": "cache-only"}

    done = places.run(store, load_config(), provider, str(tmp_path / "artifacts"))
    assert done["places_in"] == 5 and done["preserved_human_rows"] == 1 and done["resolved"] == 2
    assert sorted(open(calls).read().split("\n")[:-1]).count("Salem, Oregon") == 1
    table = {r["place_raw"]: r for r in store.read("places").collect()}
    assert table["Kept"]["review_status"] == "rejected" and table["Kept"]["id"] == 1 and "Orphan" in table
    assert table["near Salem, OR"]["geocode_conf"] == pytest.approx(0.54)
    text = (tmp_path / "artifacts" / "review_queue.csv").read_text()
    assert text == 'place_raw,occurrence_count,affected_individuals,reason\nNowhere,2,2,unresolved\n"Odd ""x"", y",1,1,unresolved\n'

    def refuse(query):
        raise AssertionError(query)

    again = places.run(store, load_config(), lambda q: refuse(q) if q == "Salem, Oregon" else provider(q), str(tmp_path / "artifacts"))
    assert again["cache_hits"] == 2 and (tmp_path / "artifacts" / "review_queue.csv").read_text() == text


def test_geocoder_answers():
    url, headers = build_request("https://geo.example/search", "me/1", "São Tomé")
    assert url.startswith("https://geo.example/search?q=S%C3%A3o+Tom%C3%A9&format=jsonv2") and headers["User-Agent"] == "me/1"
    hit = answer("x", [{"lat": "1.5", "lon": "bad", "addresstype": "Town", "importance": 3, "address": {"province": "P"}}])
    assert (hit["lat"], hit["lon"], hit["precisionTier"], hit["confidence"], hit["admin1"]) == (1.5, None, "locality", 1.0, "P")
    assert answer("x", [])["precisionTier"] == "unknown"


def test_artifacts_stay_inside(tmp_path):
    assert artifact_path(str(tmp_path), "a/b.csv").name == "b.csv"
    for name in ("../x", "/etc/x", "."):
        with pytest.raises(ValueError, match="lies outside"):
            artifact_path(str(tmp_path), name)


def test_aliases_of_a_file(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('{"componentAliases": {"nrw": "Nordrhein-Westfalen"}, "suffixAliases": {"Kr.": "Kreis", "st.": "Stadt ($1)"}}', encoding="utf-8")
    known = read_aliases(spark, f"file://{path}")
    texts = ["Ahlen KR., NRW", "Kr., OR", "Bath st.", "Bath Co"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(normalize_place(F.col("t"), known.whole, known.ending).alias("n")).collect()
    assert [r["n"] for r in got] == ["Ahlen Kreis, Nordrhein-Westfalen", "Kreis, OR", "Bath Stadt ($1)", "Bath Co"]
    for bad in ("[]", '{"componentAliases": {}}', '{"componentAliases": {"a": 1}, "suffixAliases": {}}', "{"):
        path.write_text(bad)
        with pytest.raises(AliasError, match="a.json"):
            read_aliases(spark, f"file://{path}")


def test_ids_follow_the_order_of_texts(spark):
    rows = spark.createDataFrame([(f"{(i * 7919) % 500:03d}",) for i in range(500)], "t string").repartition(6)
    assert [(r["t"], r["id"]) for r in sorted_ids(rows, "t").orderBy("t").collect()] == [(f"{i:03d}", i + 1) for i in range(500)]
    assert sorted_ids(rows.limit(0), "t").count() == 0
