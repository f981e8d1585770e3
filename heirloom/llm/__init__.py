"""Operators for large text corpora used as training data.

Nothing outside this subpackage imports it.  ``registry`` lists its queries and their SQL.
"""
