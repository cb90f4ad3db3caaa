"""Operators for training-data pipelines: filtering, deduplication, mixing, token files and packing."""
