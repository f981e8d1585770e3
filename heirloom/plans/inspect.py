"""Read-only reports on the tables of a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirloom.sources.store import Store


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name and n_rows of each."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def date_sample(events: DataFrame, dates: DataFrame, people: DataFrame, most: int = 30) -> DataFrame:
    """The first dated events with whom they concern."""
    p = people.select(F.col("id").alias("subject_id"), F.lit("individual").alias("subject_type"), "name_full")
    t = events.join(dates, events.id == dates.event_id).join(p, ["subject_type", "subject_id"], "left")
    return t.orderBy("id").limit(most).select("name_full", "event_type", "date_raw", "date_start", "date_end", "precision", "qualifier", "parse_status")


def undated(events: DataFrame, dates: DataFrame, most: int = 50) -> DataFrame:
    """Written dates that gave no interval, the most frequent first."""
    rest = events.join(dates.select(F.col("event_id").alias("id")), "id", "left_anti").where("date_raw IS NOT NULL AND trim(date_raw) <> ''")
    return rest.groupBy("date_raw").agg(F.count(F.lit(1)).alias("occurrences")).orderBy(F.desc("occurrences"), "date_raw").limit(most)


def lifespan_violations(events: DataFrame, dates: DataFrame, people: DataFrame) -> DataFrame:
    """Open dates that leave the life of their person."""
    p = people.select(F.col("id").alias("subject_id"), "name_full", "birth_start", "death_end")
    t = events.where("subject_type = 'individual'").join(dates, events.id == dates.event_id).join(p, "subject_id")
    bad = (F.col("date_start") < F.col("birth_start")) | (F.col("date_end") > F.col("death_end"))
    return t.where((F.col("qualifier").like("%BEF%") | F.col("qualifier").like("%AFT%")) & bad).orderBy("id").select("name_full", "event_type", "date_raw", "date_start", "date_end", "birth_start", "death_end")


def place_summary(places: DataFrame, cache: DataFrame) -> DataFrame:
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    s = places.agg(
        F.count(F.lit(1)).alias("total_places"), F.count_if(located).alias("geocoded_places"), F.count_if((F.col("precision_tier") == "unknown") | ~located).alias("unresolved_places"),
        F.count_if(F.col("review_status").isin("confirmed", "corrected")).alias("human_reviewed_places"),
    )
    return s.join(cache.agg(F.count(F.lit(1)).alias("cache_entries")), how="full_outer", on=F.lit(True))


def counts_by(df: DataFrame, column: str, name: str = "places") -> DataFrame:
    """Rows of each value, nulls as ``(null)``, the most frequent first."""
    return df.groupBy(F.coalesce(column, F.lit("(null)")).alias(column)).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), column)


def least_confident(places: DataFrame, most: int = 30) -> DataFrame:
    return places.where("lat IS NOT NULL AND lon IS NOT NULL").orderBy("geocode_conf", "place_raw").limit(most).select("place_raw", "place_normalized", "precision_tier", "geocode_conf", "radius_km")


def edge_types(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type", "weight").agg(F.count(F.lit(1)).alias("edges")).orderBy("edge_type", "weight")


def one_way_edges(edges: DataFrame) -> DataFrame:
    """Edges without their reverse of the same weight."""
    back = F.when(F.col("edge_type") == "parent", "child").when(F.col("edge_type") == "child", "parent").otherwise(F.col("edge_type"))
    turned = edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), back.alias("edge_type"), "weight")
    return edges.join(turned, ["from_id", "to_id", "edge_type", "weight"], "left_anti")


def kinship_integrity(edges: DataFrame, distances: DataFrame) -> DataFrame:
    """missing_reverse_edges, noncanonical_distance_pairs, bloodless_rows_with_mrca: all 0 in a sound store."""
    a = one_way_edges(edges).agg(F.count(F.lit(1)).alias("missing_reverse_edges"))
    b = distances.agg(F.count_if(F.col("a_id") >= F.col("b_id")).alias("noncanonical_distance_pairs"), F.count_if(F.col("blood_degree").isNull() & F.col("mrca_id").isNotNull()).alias("bloodless_rows_with_mrca"))
    return a.join(b, how="full_outer", on=F.lit(True))


def all_reports(store: Store) -> dict[str, DataFrame]:
    t = {n: store.read(n) for n in ("raw_records", "individuals", "families", "family_children", "events", "event_dates", "places", "geocode_cache", "kinship_edges", "kinship_distance")}
    return {
        "row_counts": row_counts(t),
        "date_sample": date_sample(t["events"], t["event_dates"], t["individuals"]),
        "undated": undated(t["events"], t["event_dates"]),
        "lifespan_violations": lifespan_violations(t["events"], t["event_dates"], t["individuals"]),
        "place_summary": place_summary(t["places"], t["geocode_cache"]),
        "precision_tiers": counts_by(t["places"], "precision_tier"),
        "review_status": counts_by(t["places"], "review_status"),
        "least_confident": least_confident(t["places"]),
        "edge_types": edge_types(t["kinship_edges"]),
        "kinship_integrity": kinship_integrity(t["kinship_edges"], t["kinship_distance"]),
    }
