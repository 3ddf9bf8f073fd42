"""Operators for large text corpora: deduplication, filtering, tokens, packing."""
