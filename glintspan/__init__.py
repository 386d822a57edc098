"""Sequence analytics on Spark: cleaning, episodes, features, rollups and group statistics."""
