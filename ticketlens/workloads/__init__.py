"""Registered queries over the given benchmark tables."""
