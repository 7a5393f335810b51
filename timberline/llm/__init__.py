"""Operators for training-data pipelines: deduplication, filters, tokens, packing.

Nothing else in the library imports this subpackage; ``queries`` holds the registered queries.
"""
