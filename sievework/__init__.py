"""Corpus curation and classifier evaluation on Spark DataFrames."""
