"""Comprehension-style collection queries over Spark DataFrames."""
