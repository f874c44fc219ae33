"""Genomic read and interval analytics on Spark DataFrames."""
