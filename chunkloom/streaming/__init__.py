"""Structured Streaming forms of the delivery, progress, run and index jobs."""
