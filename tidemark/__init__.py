"""Retrieval over multimodal notes, as Spark DataFrames."""
