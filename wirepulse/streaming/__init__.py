"""Structured Streaming versions of the ingest cycle and of the windowed counts."""
