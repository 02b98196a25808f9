"""Operators for preparing language-model training text at scale.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; `queries.py` holds the thin `opN_*` queries over the supplied tables.
"""
