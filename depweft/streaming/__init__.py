"""Structured Streaming variants of the change monitor."""
