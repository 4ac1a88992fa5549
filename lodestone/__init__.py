"""Lodestone: retrieval analytics and text-corpus operators on Spark DataFrames."""
