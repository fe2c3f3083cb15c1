"""Structured Streaming versions of the corpus pipelines."""
