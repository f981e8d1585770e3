"""Pass 2: places that events name, resolved from a cache, with a queue for people to review."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from heirloom.config import Config, load_config
from heirloom.functions.places import RESOLUTION, cache_key, normalize_place, parse_resolution, qualified_confidence, qualifier_of, resolution_json, review_reason, tier_radius
from heirloom.operators.ids import sorted_ids
from heirloom.operators.upsert import upsert
from heirloom.sources.aliases import Aliases
from heirloom.sources.progress import report, warn
from heirloom.sources.store import Store, settle, write_csv

#: Resolves a normal form to a dict with the fields of an answer; None: no answer worth keeping.
Provider = Callable[[str], Mapping]

PLACE_FIELDS = ["place_normalized", "lat", "lon", "radius_km", "precision_tier", "admin1", "admin2", "country", "geocode_source", "geocode_conf"]


def place_stats(events: DataFrame, families: DataFrame) -> DataFrame:
    """place_raw, occurrence_count, affected_individuals: events of a place, and different people that they concern.

    An event of a family concerns husband and wife.
    """
    placed = events.where("place_raw IS NOT NULL")
    counts = placed.groupBy("place_raw").agg(F.count(F.lit(1)).alias("occurrence_count"))
    own = placed.where("subject_type = 'individual'").select("place_raw", F.col("subject_id").alias("person"))
    couples = families.select(F.col("id").alias("subject_id"), F.explode(F.array_compact(F.array("husband_id", "wife_id"))).alias("person"))
    shared = placed.where("subject_type = 'family'").join(couples, "subject_id").select("place_raw", "person")
    affected = own.unionByName(shared).where("person IS NOT NULL").groupBy("place_raw").agg(F.count_distinct("person").alias("affected_individuals"))
    return counts.join(affected, "place_raw", "left").select("place_raw", "occurrence_count", F.coalesce("affected_individuals", F.lit(0)).cast("long").alias("affected_individuals"))


def ask(misses: DataFrame, provider: Provider) -> DataFrame:
    """query_hash, query_text and the answer r of a provider for distinct normal forms: each is asked for once, on the executors."""
    names = [f.split()[0] for f in RESOLUTION.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [provider(q) for q in batch["query_text"]]
            yield pd.DataFrame({"query_hash": batch["query_hash"], "query_text": batch["query_text"], **{n: pd.Series([r.get(n) for r in rows], dtype="float64" if n in ("lat", "lon", "confidence") else object) for n in names}})

    flat = misses.mapInPandas(run, f"query_hash string, query_text string, {RESOLUTION}")
    return flat.select("query_hash", "query_text", F.struct(*names).alias("r"))


def resolve(stats: DataFrame, known: DataFrame, cache: DataFrame, config: Config, provider: Provider | None = None, aliases: Aliases = Aliases()) -> tuple[DataFrame, DataFrame | None]:
    """Rows of stats with their resolution, and new cache rows.  Places that people reviewed (``known``) are left out."""
    human = known.where("review_status <> 'auto'").select("place_raw")
    todo = stats.join(human, "place_raw", "left_anti").withColumns({"normalized": normalize_place(F.col("place_raw"), aliases.whole, aliases.ending), "qualifier": qualifier_of(F.col("place_raw"))})
    todo = todo.withColumn("query_hash", F.when(F.col("normalized") != "", cache_key(F.col("normalized"))))
    held = cache.select("query_hash", parse_resolution(F.col("response_json")).alias("r")).where("r IS NOT NULL")
    answers, fresh = held.withColumn("origin", F.lit("cache")), None
    if provider is not None:
        misses = todo.where("query_hash IS NOT NULL").join(held, "query_hash", "left_anti").groupBy("query_hash").agg(F.min("normalized").alias("query_text"))
        fresh = settle(ask(misses, provider), "answers")
        answers = answers.unionByName(fresh.select("query_hash", "r", F.lit("provider").alias("origin")))
    t = todo.join(answers, "query_hash", "left")
    place = config["place"]
    tier = F.coalesce("r.precisionTier", F.lit("unknown"))
    conf = F.coalesce("r.confidence", F.lit(0.0))
    conf = F.when(F.col("qualifier").isNotNull(), qualified_confidence(conf, place["min_geocode_conf"])).otherwise(conf)
    out = t.select(
        "place_raw", "occurrence_count", "affected_individuals", F.coalesce("r.normalized", "normalized").alias("place_normalized"), "r.lat", "r.lon", tier_radius(tier, place["radius_km_by_tier"]).alias("radius_km"),
        tier.alias("precision_tier"), "r.admin1", "r.admin2", "r.country", F.coalesce("r.source", F.lit("none")).alias("geocode_source"), conf.alias("geocode_conf"), "origin",
    )
    reason = review_reason(F.col("lat"), F.col("lon"), F.col("precision_tier"), F.col("geocode_conf"), place["min_geocode_conf"], place["min_tier"])
    return out.withColumn("reason", reason), fresh


def review_queue(resolved: DataFrame) -> DataFrame:
    """Places that need a person, the most used first."""
    return resolved.where("reason IS NOT NULL").select("place_raw", "occurrence_count", "affected_individuals", "reason").orderBy(F.desc("occurrence_count"), F.desc("affected_individuals"), "place_raw")


def merged_places(known: DataFrame, resolved: DataFrame) -> DataFrame:
    """The places table: rows that no event names any more stay, reviewed rows stay as they are, new ones get the next ids."""
    top = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    named = resolved.select("place_raw", *PLACE_FIELDS)
    ids = known.select("place_raw", F.col("id").alias("__id"))
    fresh = sorted_ids(named.join(ids, "place_raw", "left_anti").select("place_raw"), "place_raw", name="__new").withColumn("__new", F.col("__new") + top)
    rows = named.join(ids, "place_raw", "left").join(fresh, "place_raw", "left").select(F.coalesce("__id", "__new").alias("id"), "place_raw", *PLACE_FIELDS, F.lit("auto").alias("review_status"))
    return upsert(known, rows, ["place_raw"], F.col("old.review_status") == "auto")


def run(store: Store, config: Config | None = None, provider: Provider | None = None, artifacts: str | None = None, aliases: Aliases = Aliases()) -> dict:
    config = config or load_config()
    known, cache = store.read("places"), store.read("geocode_cache")
    stats = settle(place_stats(store.read("events"), store.read("families")), "places")
    store.clear_for("places")
    resolved, fresh = resolve(stats, known, cache, config, provider, aliases)
    seen = Observation("places")
    counts = {
        "resolved": F.count_if(F.col("reason").isNull()), "review_queue": F.count_if(F.col("reason").isNotNull()), "cache_hits": F.count_if(F.col("origin") == "cache"), "rows": F.count(F.lit(1)),
    }
    resolved = settle(resolved.observe(seen, *[c.alias(n) for n, c in counts.items()]), "resolved")
    if fresh is not None:
        now = datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        rows = fresh.where("r.source <> 'cache-only'").select("query_hash", "query_text", resolution_json(F.col("r")).alias("response_json"), F.lit(now).alias("fetched_at"))
        store.write("geocode_cache", upsert(cache, rows, ["query_hash"]))
    store.write("places", merged_places(known, resolved))
    queue = review_queue(resolved)
    if artifacts:
        write_csv(queue, artifacts, "review_queue.csv")
    n = seen.get
    warn("places", n["review_queue"], "places want a person's look")
    total = stats.count()
    return report(
        "places", places_in=total, resolved=n["resolved"], review_queue=n["review_queue"], cache_hits=n["cache_hits"], provider_calls=fresh.count() if fresh is not None else 0,
        preserved_human_rows=total - n["rows"], caveat="Modern geocoding does not reconstruct historical boundaries.",
    )
