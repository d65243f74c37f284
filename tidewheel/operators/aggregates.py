"""Aggregates as columns, and the tree merge, which is a plan of its own."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import is_integer, is_numeric

#: Estimated cardinality: 2^16 registers, a relative standard error of 0.41 %.
CARDINALITY_BITS = 16
PERCENTILE_ACCURACY = 10_000
HISTOGRAM_BUCKETS = 10
TREE_THRESHOLD = 1


def _numeric(name: str, kind: T.DataType) -> None:
    if not (is_numeric(kind) or isinstance(kind, T.DecimalType)):
        raise TypeError(f"{name} doesn't take {kind.simpleString()}")


def count() -> tuple[Column, T.DataType]:
    """Rows, nulls included."""
    return F.count(F.lit(1)), T.LongType()


def sum_(x: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    """Integers sum to BIGINT, null on overflow; floats to DOUBLE; INT128 to INT128."""
    _numeric("sum", kind)
    if is_integer(kind):
        return F.try_sum(x.cast("long")), T.LongType()
    if isinstance(kind, T.DecimalType):
        return F.try_sum(x).cast(kind), kind
    return F.sum(x.cast("double")), T.DoubleType()


def min_(x: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    return F.min(x), kind


def max_(x: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    return F.max(x), kind


def avg(x: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    """The mean in the input's own kind: of integers truncated."""
    _numeric("avg", kind)
    if is_integer(kind):
        total = F.sum(x.cast("decimal(19,0)")) if isinstance(kind, T.LongType) else F.sum(x.cast("long"))
        return F.call_function("div", total, F.count(x).cast("decimal(19,0)" if isinstance(kind, T.LongType) else "long")).cast(kind), kind
    return F.avg(x).cast(kind), kind


def avg_exact(x: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    _numeric("avg", kind)
    return F.avg(x.cast("double")), T.DoubleType()


def pct(x: Column, kind: T.DataType, p: float, exact: bool = False) -> tuple[Column, T.DataType]:
    """The p-th percentile (0 to 100) in the input's kind: estimated from a mergeable sketch, or exact and interpolated."""
    _numeric("pct", kind)
    if not 0 <= p <= 100:
        raise ValueError("a percentile is from 0 to 100")
    if exact:
        value = F.percentile(x.cast("double"), p / 100)
        return (F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)) if is_integer(kind) else value).cast(kind), kind
    return F.percentile_approx(x, p / 100, PERCENTILE_ACCURACY).cast(kind), kind


def card(x: Column, kind: T.DataType, exact: bool = False) -> tuple[Column, T.DataType]:
    """Different values, nulls left out: estimated from a mergeable sketch, or exact."""
    if exact:
        return F.count_distinct(x), T.LongType()
    if is_integer(kind):
        x = x.cast("long")
    elif isinstance(kind, T.FloatType | T.DoubleType):
        x = (x + F.lit(0.0)).cast("string")  # one zero
    elif not isinstance(kind, T.StringType):
        x = x.cast("string")
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(x, F.lit(CARDINALITY_BITS))), F.lit(0)).cast("long"), T.LongType()


def hist(x: Column, kind: T.DataType, low: float, high: float) -> tuple[Column, T.DataType]:
    """A histogram as JSON: ``{"b":[[from, to, count, sum], ...]}``.

    Ten buckets of one width between ``low`` and ``high``, one below and one above them, whose open ends are null. Integers have
    a whole width, at least 1. Every bucket is a conditional aggregate, so the histogram takes part in the query's own
    partial aggregation, whatever its keys.
    """
    _numeric("hist", kind)
    whole = is_integer(kind)
    value = x.cast("long" if whole else "double")
    n = HISTOGRAM_BUCKETS
    if whole:
        low, high = int(low), max(int(high), int(low) + n)
        width = (high - low) // n
        edges = [low + i * width for i in range(n)] + [high]
    else:
        low, high = float(low), float(high) if high > low else float(low) + 1.0
        edges = [low + i * (high - low) / n for i in range(n)] + [high]
    inside = [(None, edges[0])] + list(zip(edges, edges[1:], strict=False)) + [(edges[-1], None)]
    parts = []
    for a, b in inside:
        holds = (value < F.lit(b)) if a is None else (value >= F.lit(a)) if b is None else (value >= F.lit(a)) & (value < F.lit(b))
        total = F.coalesce(F.sum(F.when(holds, value)), F.lit(0 if whole else 0.0))
        parts.append(F.concat(F.lit(f"[{json.dumps(a)},{json.dumps(b)},"), F.count_if(holds).cast("string"), F.lit(","), total.cast("string"), F.lit("]")))
    return F.concat(F.lit('{"b":['), F.concat_ws(",", *parts), F.lit("]}")), T.StringType()


@F.pandas_udf(T.StringType())
def _assemble(nodes: pd.Series) -> pd.Series:
    """Paths with counts, each a list of names from the first frame on, which all of them share, as nested JSON; children in order of
    their names."""

    def one(paths) -> str:
        made: dict[tuple, dict] = {}
        for path, n in sorted((tuple(p["path"]), int(p["n"])) for p in paths):  # a node comes before what is below it
            made[path] = {"name": path[-1], "value": n}
            if len(path) > 1:
                made[path[:-1]].setdefault("children", []).append(made[path])
        return json.dumps(next(iter(made.values())), separators=(",", ":"), ensure_ascii=False)

    return nodes.map(one)


def tree_counts(df: DataFrame, keys: list[str], stack: str) -> DataFrame:
    """Per key and path prefix the number of rows; paths are newline-separated, root first; the empty prefix counts every row.

    Equal stacks are counted first, so only the different ones are taken apart.
    """
    names = [F.col(f"`{k}`") for k in keys]
    stacks = df.groupBy(*names, F.coalesce(F.col(stack), F.lit("")).alias("__stack")).agg(F.count(F.lit(1)).alias("__n"))
    frames = F.when(F.col("__stack") == "", F.array().cast("array<string>")).otherwise(F.split("__stack", "\n", -1))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(frames)), lambda i: F.slice(frames, F.lit(1), i))
    return stacks.select(*names, "__n", F.explode(prefixes).alias("path")).groupBy(*names, "path").agg(F.sum("__n").alias("n"))


def tree_merge(df: DataFrame, keys: list[str], stack: str, name: str, threshold: int = TREE_THRESHOLD) -> DataFrame:
    """Per key the merged tree as JSON: ``{"name", "value", "children"}``. Nodes under the threshold go with what is below them; a root
    under it leaves an empty text.

    Counting is a plain aggregation; what reaches the threshold is put together by first frame, each in its own row, and the parts are
    joined as texts.
    """
    names = [F.col(f"`{k}`") for k in keys]
    counts = tree_counts(df, keys, stack)
    many = counts.where((F.col("n") >= threshold) | (F.size("path") == 0)).withColumn("__first", F.get("path", F.lit(0)))
    parts = many.groupBy(*names, "__first").agg(F.collect_list(F.struct("path", "n")).alias("nodes"), F.max("n").alias("n"))
    texts = parts.select(*names, "__first", F.when(F.col("__first").isNull(), F.lit("")).otherwise(_assemble(F.when(F.col("__first").isNotNull(), F.col("nodes")).otherwise(F.array(F.struct(F.array(F.lit("")).alias("path"), F.lit(0).cast("long").alias("n")))))).alias("json"), "n")
    whole = texts.groupBy(*names).agg(F.max(F.when(F.col("__first").isNull(), F.col("n"))).alias("root"), F.array_sort(F.collect_list(F.when(F.col("__first").isNotNull(), F.struct("__first", "json")))).alias("below"))
    below = F.array_join(F.transform("below", lambda x: x["json"]), ",")
    tree = F.concat(F.lit('{"name":"","value":'), F.col("root").cast("string"), F.when(F.size("below") > 0, F.concat(F.lit(',"children":['), below, F.lit("]"))).otherwise(F.lit("")), F.lit("}"))
    return whole.select(*names, F.when(F.coalesce(F.col("root"), F.lit(0)) >= threshold, tree).otherwise(F.lit("")).alias(name))
