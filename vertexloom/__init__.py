"""Property-graph analytics over event and entity tables, built on Spark DataFrames."""

__version__ = "0.1.0"
