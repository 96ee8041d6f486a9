"""Operators for large training corpora: sharding, mixing, deduplication, scanning, scoring, tokens."""
