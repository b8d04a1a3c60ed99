"""Declared, bounded queries over documents and record streams, as Spark DataFrames."""

__version__ = "0.1.0"
