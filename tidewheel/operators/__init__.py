"""Aggregates, timelines, access rules, result transforms."""
