"""Declarations of units, streams and queries, requests against them, and their validation."""
