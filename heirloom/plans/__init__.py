"""Passes over a tree, and reports."""
