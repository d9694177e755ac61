"""Operators of a training-data pipeline: duplicates, classifiers, tokens, packing, shards, neighbours.

Nothing else in the library imports this subpackage.
"""
