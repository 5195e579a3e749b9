"""Operators for preparing training data: search, deduplication, archives, mixing, scoring, encoding."""
