"""Changelog analytics on PySpark: versioned, ordered key-value logs as DataFrames."""
