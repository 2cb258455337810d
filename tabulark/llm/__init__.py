"""Operators of a training-data pipeline: packing, deduplication, filters, sharding.

Nothing else in the package imports this subpackage.  Every operator takes and
returns DataFrames; ``queries.py`` holds the thin queries over whole tables.
"""
