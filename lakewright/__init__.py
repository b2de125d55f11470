"""Lakehouse curation, change merging, table care and job diagnostics as Spark DataFrames."""

__version__ = "0.1.0"
