"""What clients do with results: pivot, computed columns, histograms as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot(df: DataFrame, key: str, metric: str, values: Sequence | None = None) -> DataFrame:
    """A key's values become columns of the one metric; missing ones are 0. Keys that remain, such as the window, stay keys.

    Without ``values``, the key's different values are asked for first, in order; name them where they are many.
    """
    rest = [c for c in df.columns if c not in (key, metric)]
    grouped = df.groupBy(*(F.col(f"`{c}`") for c in rest))
    shaped = (grouped.pivot(key, list(values)) if values is not None else grouped.pivot(key)).agg(F.first(F.col(f"`{metric}`")))
    return shaped.fillna(0, subset=[c for c in shaped.columns if c not in rest])


def map_columns(df: DataFrame, columns: Mapping[str, str | Column]) -> DataFrame:
    """Add columns computed from a row's others, each an SQL expression or a column."""
    return df.withColumns({n: F.expr(c) if isinstance(c, str) else c for n, c in columns.items()})


def remove(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def unpack_histogram(df: DataFrame, column: str, label: str = "label", count: str = "count") -> DataFrame:
    """A row per bucket of a histogram: its range as a label, and its count."""
    rest = [c for c in df.columns if c != column]
    bucket = F.explode(F.from_json(F.col(column), "struct<b:array<array<string>>>")["b"]).alias("b")
    edge = lambda i: F.coalesce(F.nullif(F.get("b", F.lit(i)), F.lit("null")), F.lit(""))
    return df.select(*rest, bucket).select(*rest, F.concat(F.lit("["), edge(0), F.lit(","), edge(1), F.lit(")")).alias(label), F.get("b", F.lit(2)).cast("long").alias(count))
