"""Operators on DataFrames: ids, hierarchy, upserts, kinship graphs."""
