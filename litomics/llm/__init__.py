"""Operators for preparing training text: deduplication, filtering, redaction, sharding and packing."""
