"""Structured Streaming jobs over the file source."""
