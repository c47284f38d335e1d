"""Ingest from streams."""
