"""Embedding-table analytics on Spark: ingest, join, neighbourhood geometry, density and rank statistics as DataFrame operators."""
