"""Operators of a training-data pipeline: identification, filtering, deduplication, mixing, archives."""
