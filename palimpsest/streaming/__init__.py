"""Incremental tables with Structured Streaming."""
