"""Grids, experiment tables, fixture views and the query registry."""
