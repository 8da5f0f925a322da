"""Operators of a training-data pipeline: tokenising, filtering, deduplication, scoring, packing, search.

Nothing else in the library imports this subpackage.
"""
