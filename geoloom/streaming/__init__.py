"""Incremental readers."""
