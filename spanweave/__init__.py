"""Spatial networks and training-data preparation on Spark DataFrames."""
