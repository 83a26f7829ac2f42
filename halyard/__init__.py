"""Filtered vector search analytics and training-data preparation on Spark DataFrames."""
