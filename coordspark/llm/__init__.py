"""Operators for preparing training text: dedup, sharding, scoring, packing, record files."""
