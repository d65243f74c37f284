"""Conversions between what files hold and what schemas declare."""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import is_integer, zero


def normalize(name: str) -> str:
    """A header as a column name: lower case, anything but ASCII letters and digits as one underscore a run."""
    return re.sub("[^A-Za-z0-9]+", "_", name).lower()


def headers(names: Sequence[str]) -> list[str]:
    """Normalized headers; empty ones by their place, repeated ones numbered."""
    return unique([normalize(n) or f"col_{i}" for i, n in enumerate(names)])


def unique(names: Sequence[str]) -> list[str]:
    """The names in order; a name that is taken gets the first number that makes it different."""
    taken: dict[str, None] = {}
    for base in names:
        numbered = (f"{base}_{n}" for n in itertools.count(1))
        taken[next(n for n in itertools.chain((base,), numbered) if n not in taken)] = None
    return list(taken)


def from_text(value: Column, kind: T.DataType, formatted: bool = False) -> Column:
    """A text in a declared kind; what can't be read is the kind's zero. ``formatted``: numbers lose commas and spaces, integers end
    at the dot."""
    if isinstance(kind, T.StringType):
        return F.coalesce(value, F.lit(""))
    if formatted and not isinstance(kind, T.BooleanType):
        value = F.regexp_replace(value, "[, ]", "")
        if is_integer(kind):
            value = F.split_part(value, F.lit("."), F.lit(1))
    return or_zero(value.try_cast(kind), kind)


def or_zero(value: Column, kind: T.DataType) -> Column:
    fill = zero(kind)
    return value if fill is None else F.coalesce(value, F.lit(fill).cast(kind))
