"""Similarity search over embedded media collections, and training-data operators, on Spark DataFrames."""
