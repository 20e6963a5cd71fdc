"""Readers and writers: graph documents, repositories, traces, driver tables."""
