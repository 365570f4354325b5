"""refloom: cross-reference analytics over document corpora as plain Spark DataFrames."""

__version__ = "0.1.0"
