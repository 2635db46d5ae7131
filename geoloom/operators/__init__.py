"""Operators on layers: each takes layers and returns new ones."""
