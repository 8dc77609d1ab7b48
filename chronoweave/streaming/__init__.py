"""Incremental forms for unbounded span sources."""
