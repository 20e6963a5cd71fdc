"""Iteration support and the query catalogue."""
