"""Heirloom: genealogical analytics on Spark DataFrames."""
