"""Structured Streaming versions of incremental operators."""
