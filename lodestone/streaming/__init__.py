"""Structured Streaming forms of the usage analytics."""
