"""Structured Streaming ingest of execution events."""
