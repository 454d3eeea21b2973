"""Whole flows put together from the jobs."""
