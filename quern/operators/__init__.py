"""Queries, reductions and mutations as DataFrame transformations."""
