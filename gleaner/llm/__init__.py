"""Operators for preparing training text: sharding, extraction, dedup, scoring, packing, archives."""
