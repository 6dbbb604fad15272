"""Kairolake: per-second evidence analytics on Spark DataFrames."""
