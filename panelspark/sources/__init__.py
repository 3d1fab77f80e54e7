"""Readers and writers: CSV feeds, wide matrices, Stata files, boundaries, product tables."""
