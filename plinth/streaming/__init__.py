"""Incremental snapshots with Structured Streaming."""
