"""Corpus building, auditing, scoring and parameter statistics on Spark DataFrames."""
