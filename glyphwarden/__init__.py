"""Bulk document threat scanning and scan-history analytics on Spark DataFrames."""
