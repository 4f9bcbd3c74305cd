"""Siltbed: analytics over versioned key-value operation logs, on Spark DataFrames."""

__version__ = "0.1.0"
