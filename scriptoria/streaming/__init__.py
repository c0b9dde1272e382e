"""Structured Streaming jobs that keep derived tables up to date."""
