"""Corpus preparation at scale: deduplication, scoring, tokenizing, packing and search over Spark tables."""
