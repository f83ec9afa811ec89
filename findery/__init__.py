"""Hybrid retrieval over collections of documents, built on Spark DataFrames."""
