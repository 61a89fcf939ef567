"""Structured Streaming forms of the store's incremental operators."""
