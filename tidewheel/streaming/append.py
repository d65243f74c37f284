"""Appending a stream to a table that queries read as a batch.

Each micro-batch becomes one directory named by its id, replaced when the batch runs again; so a restart from the checkpoint neither
loses nor repeats rows. There is no watermark: late rows of any time are kept, rows without a time (0) are dropped. Windows are a
matter of queries, not of the stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..catalog import DATE, Catalog, Table, drop_days
from ..schema import TIME
from ..sources.files import of_json_texts
from ..sources.thrift import of_thrift

#: Messages in a segment of a topic.
SEGMENT = 10_000


def segments(first: int, last: int, width: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Whole aligned segments [k * width, (k + 1) * width) of the offsets from ``first`` to before ``last``. The tail waits until it is full."""
    at = first - first % width
    while at + width <= last:
        yield max(at, first), at + width
        at += width


def _messages(df: DataFrame, schema: T.StructType, serde: str, columns_map: Mapping | None) -> DataFrame:
    """Message values as columns. The message's time becomes ``_time_`` unless the payload has one. A message that can't be read gives a row
    of zeros (JSON) or nulls (Thrift) at the message's time."""
    stamped = df.withColumn("__stamp", F.unix_seconds("timestamp"))
    payload = T.StructType([f for f in schema if f.name != TIME or TIME in (columns_map or {}) or serde == "JSON" and TIME in schema.names])
    if serde == "THRIFT":
        rows = of_thrift(stamped, "value", payload, columns_map or {}, keep=["__stamp"])
    else:
        rows = of_json_texts(stamped.withColumn("value", F.col("value").cast("string")), "value", payload, columns_map, keep=["__stamp"])
    time = F.coalesce(F.nullif(F.col(TIME).cast("long"), F.lit(0).cast("long")), F.col("__stamp")) if TIME in rows.columns else F.col("__stamp")
    return rows.withColumn(TIME, time).drop("__stamp")


def kafka_stream(spark: SparkSession, brokers: str, topic: str, schema: T.StructType, since_ms: int | None = None, serde: str = "JSON", columns_map: Mapping | None = None, size: int = SEGMENT, **options: str) -> DataFrame:
    """A topic as a stream of columns, from a time on, at least ``size`` messages a batch where they come in time."""
    reader = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": brokers, "subscribe": topic, "minOffsetsPerTrigger": str(size), "maxOffsetsPerTrigger": str(100 * size)}, **options)
    reader = reader.option("startingTimestamp", str(since_ms)) if since_ms is not None else reader.option("startingOffsets", "earliest")
    return _messages(reader.load(), schema, serde, columns_map)


#: Gets messages (value, timestamp and the like) by the options of Spark's batch source.
Reader = Callable[[Mapping[str, str]], DataFrame]


def _batch(spark: SparkSession, options: Mapping[str, str], reader: Reader | None) -> DataFrame:
    return reader(options) if reader else spark.read.format("kafka").options(**options).load()


def kafka_batches(spark: SparkSession, brokers: str, topic: str, schema: T.StructType, offsets: Mapping[int, tuple[int, int]], serde: str = "JSON", columns_map: Mapping | None = None, size: int = SEGMENT, reader: Reader | None = None) -> DataFrame:
    """The whole segments of ``size`` offsets in a range of each partition, as a batch; a tail that isn't full waits."""
    whole = {p: list(segments(first, last, size)) for p, (first, last) in offsets.items()}
    ranges = {p: (s[0][0], s[-1][1]) if s else (offsets[p][0], offsets[p][0]) for p, s in whole.items()}
    edge = lambda i: json.dumps({topic: {str(p): r[i] for p, r in ranges.items()}})
    options = {"kafka.bootstrap.servers": brokers, "assign": json.dumps({topic: sorted(ranges)}), "startingOffsets": edge(0), "endingOffsets": edge(1)}
    return _messages(_batch(spark, options, reader), schema, serde, columns_map)


def kafka_messages(spark: SparkSession, brokers: str, topic: str, schema: T.StructType, since_ms: int | None = None, serde: str = "JSON", columns_map: Mapping | None = None, reader: Reader | None = None) -> DataFrame:
    """What a topic holds now, from a time on, as a batch."""
    start = {"startingTimestamp": str(since_ms), "startingOffsetsByTimestampStrategy": "latest"} if since_ms is not None else {"startingOffsets": "earliest"}
    return _messages(_batch(spark, {"kafka.bootstrap.servers": brokers, "subscribe": topic, "endingOffsets": "latest", **start}, reader), schema, serde, columns_map)


class AppendStream:
    """A table that grows by a stream's micro-batches, under ``path``."""

    def __init__(self, catalog: Catalog, name: str, path: str):
        self.catalog, self.name, self.path = catalog, name, path.rstrip("/")

    def start(self, stream: DataFrame, trigger: Mapping | None = None) -> StreamingQuery:
        """Write every batch to its own directory. ``stream`` has ``_time_``."""

        def write(batch: DataFrame, batch_id: int) -> None:
            rows = batch.where(F.col(TIME) != 0).withColumn(DATE, F.date_from_unix_date(F.floor(F.col(TIME) / 86400).cast("int")))
            rows.write.mode("overwrite").partitionBy(DATE).parquet(f"{self.path}/data/batch={batch_id}")

        fs, p = self.catalog._fs(f"{self.path}/schema.json")
        out = fs.create(p, True)
        out.write(T.StructType([*stream.schema, T.StructField(DATE, T.DateType()), T.StructField("batch", T.LongType())]).json().encode())
        out.close()
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{self.path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()

    def refresh(self, **more) -> Table:
        """Register what is complete so far; any process may, once the stream has been started somewhere."""
        stored = self.catalog.spark.read.text(f"{self.path}/schema.json", wholetext=True).first()[0]
        df = self.catalog.spark.read.schema(T.StructType.fromJson(json.loads(stored))).option("basePath", f"{self.path}/data").parquet(f"{self.path}/data/batch=*")
        return self.catalog.register(self.name, df.drop("batch"), **more)

    def retain(self, max_seconds: float) -> int:
        """Remove the days that ended more than ``max_seconds`` ago; how many directories went."""
        return drop_days(self.catalog, f"{self.path}/data/batch=*", int(self.catalog.now() - max_seconds))
