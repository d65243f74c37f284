"""A seeded table of the shape that tests and demos use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TIME

START, END = 1546300800, 1556668800  # 2019-01-01 to 2019-05-01
STACKS = tuple("\n".join(p) for p in (["main"], ["main", "read"], ["main", "read", "parse"], ["main", "read", "seek"], ["main", "plan"], ["main", "plan", "fold"], ["main", "run"], ["main", "run", "scan"], ["main", "run", "scan", "page"], ["main", "send"]))


def synthetic(spark: SparkSession, rows: int = 10_000, seed: int = 7, start: int = START, end: int = END) -> DataFrame:
    """Rows of every kind; the same for the same seed, whatever the partitions."""
    dice = lambda k, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(n))
    pick = lambda k, values: F.element_at(F.array(*map(F.lit, values)), (dice(k, len(values)) + 1).cast("int"))
    return spark.range(rows).select(
        (F.lit(start) + dice(1, end - start)).cast("long").alias(TIME),
        dice(2, 1000).cast("int").alias("id"),
        F.concat(F.lit("event-"), dice(3, 50).cast("string")).alias("event"),
        pick(4, ["a", "b", "c", "d"]).alias("tag"),
        F.transform(F.sequence(F.lit(1).cast("long"), dice(5, 3) + 1), lambda i: F.concat(F.lit("item"), i.cast("string"))).alias("items"),
        (dice(6, 2) == 1).alias("flag"),
        F.when(dice(7, 10) > 0, dice(8, 128)).cast("byte").alias("value"),
        (dice(9, 1_000_000) / 1000.0).cast("double").alias("weight"),
        dice(10, 1 << 40).cast("decimal(38,0)").alias("stamp"),
        pick(11, STACKS).alias("stack"),
    )
