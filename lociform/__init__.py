"""Genomic variant analytics and data preparation as Spark jobs."""
