"""Hierarchical conversation memory and hybrid search on Spark."""
