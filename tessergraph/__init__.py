"""Provenance-tracked knowledge-graph analytics on Spark DataFrames."""
