"""Operators of a training-data pipeline: search, filters, extraction,
deduplication, mixing and packing over the corpus tables."""
