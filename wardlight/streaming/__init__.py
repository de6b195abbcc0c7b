"""Structured Streaming versions of the pipelines."""
