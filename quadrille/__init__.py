"""Spatial, numeric and experiment analytics as declarative Spark plans."""
