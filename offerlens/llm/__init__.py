"""Operators for training-data pipelines: deduplication, extraction, packing, mixing, language, archives, quality."""
