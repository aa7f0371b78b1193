"""Incremental index growth with Structured Streaming."""
