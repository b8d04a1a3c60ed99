"""Structured Streaming into record streams."""
