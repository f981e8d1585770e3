"""Pass 3: the kinship graph, and what it says of the pairs that are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirloom.config import Config, load_config
from heirloom.operators.graph import analyze_pairs, build_edges
from heirloom.operators.upsert import upsert
from heirloom.sources.progress import report
from heirloom.sources.store import Store, settle


def run(store: Store, config: Config | None = None) -> dict:
    """Replace the edges; stored distances are stale then and go."""
    families, children = store.read("families"), store.read("family_children")
    edges = settle(build_edges(families, children), "edges")
    store.clear_for("kinship")
    store.write("kinship_edges", edges)
    return report("kinship", families=families.count(), family_children=children.count(), edges=edges.count(), distance_strategy="on_demand_memoized", persisted_distance_rows=0)


def resolve_pairs(store: Store, pairs: DataFrame, config: Config | None = None) -> DataFrame:
    """Analyse pairs (a, b) and keep their distances; ids that no person has are an error."""
    config = config or load_config()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    unknown = ids.join(store.read("individuals").select("id"), "id", "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"unknown individuals: {[r['id'] for r in unknown]}")
    found = settle(analyze_pairs(store.read("kinship_edges"), pairs, config["kinship"]), "analysis")
    rows = found.select("a_id", "b_id", "blood_degree", "graph_degree", "mrca_id", F.col("same_branch").cast("int").alias("same_branch"))
    store.write("kinship_distance", upsert(store.read("kinship_distance"), rows, ["a_id", "b_id"]))
    return found


def summary(store: Store, a: int, b: int, config: Config | None = None) -> str:
    """How two people are related, in words."""
    pair = store.spark.createDataFrame([(a, b)], "a long, b long")
    return resolve_pairs(store, pair, config).select("relationship").first()[0]
