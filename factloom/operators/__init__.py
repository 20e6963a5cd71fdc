"""Relational and iterative operators over evidence-graph tables."""
