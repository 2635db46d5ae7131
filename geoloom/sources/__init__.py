"""Readers and writers of layers."""
