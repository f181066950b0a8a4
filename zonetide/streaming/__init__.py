"""Structured Streaming: ingestion, windows, state, joins, monitoring."""
