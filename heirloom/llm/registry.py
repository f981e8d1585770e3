"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heirloom.llm import fill_middle, line_dedup, metric_join, mixture, preferences, quality, sharding, shingle_join, suffix_dedup, toxicity, turn_repair, url_rules, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        quality.op1_additive_quality,
        toxicity.op2_nearest_toxic,
        url_rules.op3_url_rules,
        mixture.op4_curriculum_mix,
        shingle_join.op5_forest_join,
        metric_join.op6_metric_join,
        winnowing.op7_winnowing,
        sharding.op8_hypergeometric_shards,
        preferences.op9_preference_format,
        suffix_dedup.op10_suffix_sort,
        line_dedup.op11_line_dedup,
        fill_middle.op12_fill_in_middle,
        turn_repair.op13_turn_repair,
    )
}

SQL: dict[str, str] = {
    "op3_url_rules": url_rules.SQL,
    "op4_curriculum_mix": mixture.SQL,
    "op5_forest_join": shingle_join.SQL,
    "op6_metric_join": metric_join.SQL,
    "op7_winnowing": winnowing.SQL,
    "op9_preference_format": preferences.SQL,
    "op10_suffix_sort": suffix_dedup.SQL,
    "op11_line_dedup": line_dedup.SQL,
    "op12_fill_in_middle": fill_middle.SQL,
}
