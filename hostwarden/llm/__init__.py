"""Operators of a training-data pipeline: filtering, deduplication, packing, formatting and scoring of texts."""
