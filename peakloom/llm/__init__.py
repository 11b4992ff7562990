"""Operators for preparing training text: filtering, scoring, deduplication, encoding, packing."""
