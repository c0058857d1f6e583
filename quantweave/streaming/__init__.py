"""Structured Streaming forms of bar, event and regime operators."""
