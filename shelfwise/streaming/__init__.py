"""Incremental landing of weekly feed files with Structured Streaming."""
