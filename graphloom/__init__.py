"""Typed property graphs from tables and documents, on Spark DataFrames."""
