"""Operators for preparing training data: deduplication, search, packing, scanning and scoring."""
