"""Operators for preparing training data at scale: packing, sharding, near-duplicate
detection, mixing, search, scoring, line and passage deduplication, nearest
neighbours and language identification.

Nothing else in the library imports this subpackage.
"""
