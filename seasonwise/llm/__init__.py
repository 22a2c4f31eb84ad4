"""Operators for preparing training data at scale: dedup, search, extraction, scoring, tokens."""
