"""Column vectors, such as a sheet's columns: a small document on the driver."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schema import is_integer, zero
from .convert import headers


def _value(cell, kind: T.DataType):
    """A cell in its kind; what can't be read, and what is missing, is zero."""
    if cell is None:
        return zero(kind)
    try:
        if isinstance(kind, T.StringType):
            return cell if isinstance(cell, str) else str(cell)
        if isinstance(kind, T.BooleanType):
            return cell if isinstance(cell, bool) else str(cell).strip().lower() in ("true", "1")
        text = str(cell).replace(",", "").strip()
        return int(float(text)) if is_integer(kind) else float(text)
    except (TypeError, ValueError, OverflowError):
        return zero(kind)


def read_vectors(spark: SparkSession, vectors: Sequence[Sequence], schema: T.StructType | None = None, headless: bool = False) -> DataFrame:
    """``[[header, v1, v2, ...], ...]`` as rows. Ragged columns are padded with zeros; repeated headers are numbered.

    With a schema, columns go by header, or by place if ``headless``; without one, all are texts.
    """
    names = [f"col_{i}" for i in range(len(vectors))] if headless else headers([str(x[0]) if x else "" for x in vectors])
    cells = [list(x) if headless else list(x[1:]) for x in vectors]
    if schema is None:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if headless:
        names = [*schema.names, *names[len(schema.names) :]][: len(names)]
    at = {n: i for i, n in enumerate(names)}
    size = max(map(len, cells), default=0)
    columns = [cells[at[f.name]] if f.name in at else [] for f in schema]
    rows = itertools.islice(itertools.zip_longest(*columns), size) if columns else ()
    data = [tuple(_value(x, f.dataType) for x, f in zip(row, schema, strict=True)) for row in rows]
    data += [tuple(zero(f.dataType) for f in schema)] * (size - len(data))
    return spark.createDataFrame(data, schema)
