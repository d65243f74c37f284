"""Queries, fluent or as requests, and how they become plans."""
