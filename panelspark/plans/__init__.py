"""Whole pipelines, each ending in a product table."""
