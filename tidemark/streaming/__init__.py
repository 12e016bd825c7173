"""Structured Streaming forms of the session, look-ahead and deduplication operators."""
