"""Versioned-state analytics on Spark: histories of keyed records as DataFrames."""
