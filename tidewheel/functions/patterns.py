"""LIKE and prefix patterns: only % is a wildcard, and nothing escapes it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Case-insensitive matches fold ASCII letters only.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fold(value: Column) -> Column:
    return F.translate(value, _UPPER, _UPPER.lower())


def fold_text(text: str) -> str:
    return text.translate(str.maketrans(_UPPER, _UPPER.lower()))


def escaped(pattern: str) -> str:
    """A pattern for Spark, in which _ and \\ stand for themselves."""
    return pattern.replace("\\", "\\\\").replace("_", "\\_")


def like(value: Column, pattern: str, case_sensitive: bool = True) -> Column:
    if not case_sensitive:
        value, pattern = fold(value), fold_text(pattern)
    return value.like(escaped(pattern))


def starts(value: Column, prefix: str, case_sensitive: bool = True) -> Column:
    if not case_sensitive:
        value, prefix = fold(value), fold_text(prefix)
    return value.startswith(prefix)
