"""Structured Streaming forms of ingest, current truth and progress counts."""
