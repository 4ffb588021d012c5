"""Corvane: documentation ingest, search and table processing as Spark DataFrames."""

__version__ = "0.1.0"
