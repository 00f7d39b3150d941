"""Operators over images that keep arriving."""
