"""Structured Streaming: incremental upserts."""
