"""Operators for preparing training text: deduplication, sharding, packing, search, mixing, quality, privacy, archives."""
