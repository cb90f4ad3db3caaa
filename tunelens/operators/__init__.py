"""Joins, aggregates, windows and selections over the engine's tables."""
