"""Readers, ingest cleaning and sinks."""
