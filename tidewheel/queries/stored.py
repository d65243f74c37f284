"""Registered queries that first put a table somewhere else (files, topics, services), and then ask the engine that loads it from there."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions.codecs import hash_bucket
from ..functions.timefns import wall_seconds
from ..plans.expressions import Expr, col, count, max_, sum_, v
from ..schema import parse_schema
from ..sources import read_vectors
from ..sources.remote import http_table, read_sheet
from ..sources.synthetic import synthetic
from ..sources.thrift import of_thrift
from ..spec import table_spec
from ..streaming import AppendStream

#: The clock of these engines: 2024-02-01.
NOW = 1706745600
DAY = 86400
#: Of how many customers each nation's share is one JSON document.
PAGED = 250_000


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or, on one machine only, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set; these queries need a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidewheel-stored-")
        atexit.register(shutil.rmtree, base, True)
        base = f"file://{base}"
    return f"{base.rstrip('/')}/stored/{uuid.uuid4().hex}"


def events(spark: SparkSession, d: str) -> DataFrame:
    """The events with their time as seconds, and without the other columns' nulls."""
    df = spark.read.parquet(f"{d}/events.parquet")
    return df.select("event_id", "event_type", "user_id", "value", wall_seconds(F.col("ts")).alias("at"))


EVENTS = "(SELECT event_id, event_type, user_id, value, epoch_us(ts) // 1000000 AS _time_ FROM events)"
SCHEMA = "ROW<event_id:bigint, event_type:string, user_id:bigint, value:double, at:bigint>"
FIELDS = tuple(map(col, ("event_id", "event_type", "user_id", "value", "_time_")))
TIME = {"type": "column", "column": "at", "pattern": "UNIXTIME"}


def ask(spark: SparkSession, node: Mapping, *fields: Expr, name: str = "t", root: str | None = None, **more) -> DataFrame:
    """Load a config section as a table, and select."""
    e = Engine(spark, root, now=lambda: NOW, **more)
    e.catalog.add_spec(table_spec(name, node))
    e.catalog.load(name)
    return e.table(name).select(*(fields or FIELDS)).build()


def source_csv(spark, d):
    at = folder(spark)
    events(spark, d).write.csv(at, header=True, quoteAll=True, compression="gzip")
    return ask(spark, {"schema": SCHEMA, "source": at, "format": "csv", "csv": {"hasHeader": True, "compression": "gzip"}, "time": TIME})


def source_json(spark, d):
    at = folder(spark)
    events(spark, d).select(F.col("event_id").alias("id"), "event_type", F.struct("user_id").alias("who"), "value", "at").write.json(at)
    return ask(spark, {"schema": SCHEMA, "source": at, "format": "json", "json": {"columnsMap": {"event_id": "id", "user_id": "who.user_id"}}, "time": TIME})


def source_json_document(spark, d):
    """Each nation's customers are one document, in a file of its own; of large tables several, so that no document grows with the table."""
    at = folder(spark)
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    page = F.pmod(F.xxhash64("c_custkey"), F.lit(rows.count() // PAGED + 1))
    rows.groupBy("c_nationkey", page.alias("page")).agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal")).alias("rows")).alias("page"))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(at)
    fields = ("c_custkey", "c_name", "c_acctbal")
    return ask(spark, {"schema": "ROW<c_custkey:bigint, c_name:string, c_acctbal:double>", "source": at, "format": "json", "json": {"rowsField": "page.rows"}, "time": {"type": "static", "value": 5}}, *map(col, fields))


def source_parquet(spark, d):
    """Declared columns in kinds of their own; the rest isn't read."""
    node = {"schema": "ROW<l_orderkey:string, l_linenumber:bigint, l_quantity:int>", "source": f"{d}/lineitem.parquet", "format": "parquet", "time": {"type": "static", "value": 7}}
    return ask(spark, node, *map(col, ("l_orderkey", "l_linenumber", "l_quantity", "_time_")))


def source_vectors(spark, d):
    """The nations, a table of fixed size, as column vectors."""
    rows = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name").collect()
    vectors = [["Nation Key", *(str(r.n_nationkey) for r in rows)], ["NAME", *(r.n_name for r in rows)]]
    return read_vectors(spark, vectors, parse_schema("ROW<nation_key:bigint, name:string>"))


def source_sheet(spark, d):
    rows = spark.read.parquet(f"{d}/region.parquet").select("r_regionkey", "r_name").collect()
    answer = json.dumps({"values": [["Region", *(r.r_name for r in rows)], ["Key", *(str(r.r_regionkey) for r in rows)]]}).encode()
    return read_sheet(spark, "id", 100, 2, parse_schema("ROW<key:bigint, region:string>"), "token", lambda url, headers, body: answer)


def source_http(spark, d):
    """A service that answers each page with CSV."""
    pages = {f"http://pages/{r.n_nationkey}": f"n_nationkey,n_name\n{r.n_nationkey},{r.n_name}\n".encode() for r in spark.read.parquet(f"{d}/nation.parquet").collect()}
    return http_table(spark, sorted(pages), "CSV", parse_schema("ROW<n_nationkey:bigint, n_name:string>"), fetch=lambda url, headers, body: pages[url])


def source_thrift(spark, d):
    """Parts as messages of Thrift's binary protocol."""
    field = lambda kind, number, payload: F.concat(F.lit(f"{kind:02X}{number:04X}"), payload)
    number = lambda c: F.lpad(F.hex(F.col(c).cast("long")), 16, "0")
    text = lambda c: F.concat(F.lpad(F.hex(F.octet_length(c).cast("long")), 8, "0"), F.hex(F.col(c).cast("binary")))
    nested = F.concat(field(11, 1, text("p_brand")), field(10, 2, number("p_size")), F.lit("00"))
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.unhex(F.concat(field(10, 1, number("p_partkey")), field(12, 2, nested), field(11, 3, text("p_name")), F.lit("00"))).alias("value"))
    return of_thrift(rows, "value", parse_schema("ROW<p_partkey:bigint, p_name:string, p_brand:string, p_size:int>"), {"p_partkey": 1, "p_name": 3, "p_brand": 2001, "p_size": 2002})


def source_kafka(spark, d):
    """Events as messages; the topic is stood in for by a frame of the same columns."""
    rows = events(spark, d)
    messages = rows.select(F.to_json(F.struct("event_id", "event_type", "user_id", "value")).cast("binary").alias("value"), F.timestamp_seconds("at").alias("timestamp"))
    node = {"schema": "ROW<event_id:bigint, event_type:string, user_id:bigint, value:double>", "data": "kafka", "loader": "Streaming", "format": "json", "source": "broker:9092", "kafka": {"topic": "events"}}
    e = Engine(spark, now=lambda: NOW, kafka=lambda options: messages)
    e.catalog.add_spec(table_spec("t", node))
    e.catalog.load("t")
    return e.table("t").select(*FIELDS).build()


def source_synthetic(spark, d):
    """Rows made from their numbers: sums that the rule fixes."""
    return synthetic(spark, 10_000).agg(F.count(F.lit(1)).alias("n"))


def loader_swap(spark, d):
    """Two loads of a snapshot: the second replaces the first."""
    at, root = folder(spark), folder(spark)
    rows = events(spark, d)
    e = Engine(spark, root, now=lambda: NOW)
    for part, where in (("a", "event_id % 2 = 0"), ("b", "event_id % 3 = 0")):
        rows.where(where).write.parquet(f"{at}/{part}")
        e.catalog.add_spec(table_spec("t", {"schema": SCHEMA, "source": f"{at}/{part}", "format": "parquet", "time": TIME}))
        e.catalog.load("t")
    return e.table("t").select(*FIELDS).build()


def loader_roll(spark, d):
    """A folder a day, ten days back; their names give the time."""
    at = folder(spark)
    rows = events(spark, d).withColumn("date", F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd"))
    rows.repartition("date").write.partitionBy("date").parquet(f"{at}/events")
    node = {"schema": "ROW<event_id:bigint, event_type:string, user_id:bigint, value:double>", "source": f"{at}/events/date={{date}}", "loader": "Roll", "format": "parquet", "time": {"type": "macro"}, "retention": {"max-hr": 240}}
    e = Engine(spark, now=lambda: 1705968000)  # 2024-01-23
    e.catalog.add_spec(table_spec("t", node))
    e.catalog.load("t")
    return e.table("t").select(*FIELDS).build()


def loader_template(spark, d):
    """One of several folders, by a macro that also fills a column."""
    at = folder(spark)
    events(spark, d).repartition("event_type").write.partitionBy("event_type").parquet(at)
    node = {"schema": "ROW<event_id:bigint, kind:string, tens:bigint, at:bigint>", "source": f"{at}/event_type={{KIND}}", "loader": "Template", "format": "parquet", "time": TIME, "macros": {"kind": ["click", "view", "purchase"]}, "columns": {"kind": {"from_macro": "kind"}, "tens": {"expr": "event_id div 10"}}}
    e = Engine(spark, now=lambda: NOW)
    e.catalog.add_spec(table_spec("t", node))
    name = e.catalog.load_template("t", {"kind": ["view", "purchase"]})
    return e.table(name).select(*map(col, ("event_id", "kind", "tens", "_time_"))).build()


def loader_api(spark, d):
    """A table that a request describes, in its own bucket."""
    at = folder(spark)
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    rows.withColumn("bucket", F.lpad(hash_bucket(F.col("o_custkey"), 16).cast("string"), 2, "0")).repartition("bucket").write.partitionBy("bucket").parquet(at)
    node = {"schema": "ROW<o_orderkey:bigint, o_custkey:bigint, o_totalprice:double>", "source": f"{at}/bucket={{bucket}}", "loader": "Api", "format": "parquet", "time": {"type": "static", "value": 3}, "bucket": {"size": 16, "column": "o_custkey"}, "macros": {"bucket": ["00"]}}
    e = Engine(spark, now=lambda: NOW)
    e.catalog.add_spec(table_spec("t", node))
    name = e.catalog.load_template("t", {"o_custkey": "7"})
    return e.table(name).where(col("o_custkey") == 7).select(*map(col, ("o_orderkey", "o_custkey", "o_totalprice"))).build()


def retention(spark, d):
    """Rows from 2024-01-15 12:00 on, once older ones are given up and their days removed."""
    root = folder(spark)
    e = Engine(spark, root, now=lambda: NOW)
    e.catalog.publish("t", events(spark, d).withColumnRenamed("at", "_time_"))
    e.catalog.retain("t", NOW - 1705320000)
    e.catalog.vacuum("t")
    e.catalog.open("t")
    return e.table("t").select(*FIELDS).build()


def partition_cube(spark, d):
    """A filter on a declared partition reads its chunk only."""
    root = folder(spark)
    node = {"schema": SCHEMA, "source": f"{root}/in", "format": "parquet", "time": TIME, "columns": {"event_type": {"partition": {"values": ["click", "view", "purchase", "error", "signup", "login", "logout", "search"], "chunk": 1}, "dict": True, "bloom_filter": True}}}
    rows = events(spark, d)
    rows.write.parquet(f"{root}/in")
    e = Engine(spark, f"{root}/tables", now=lambda: NOW)
    e.catalog.add_spec(table_spec("t", node))
    e.catalog.load("t")
    return e.table("t").where(col("event_type") == v("purchase")).select(*FIELDS).build()


def time_to_live(spark, d):
    """What is left of three tables after eleven seconds, of which one lives ten and one was asked for in between."""
    clock = [NOW]
    e = Engine(spark, now=lambda: clock[0])
    rows = spark.read.parquet(f"{d}/region.parquet")
    for name, ttl in (("kept", 0), ("brief", 10), ("renewed", 10)):
        e.catalog.register(name, rows, ttl=ttl)
    clock[0] += 6
    e.table("renewed")
    clock[0] += 5
    names = e.catalog.list()
    return spark.createDataFrame([(n,) for n in names], "name string").join(e.table("renewed").select(count(v(1)).as_("n")).build())


def stream_append(spark, d):
    """Micro-batches of files, appended exactly once, over two runs of the stream."""
    at = folder(spark)
    rows = events(spark, d).withColumnRenamed("at", "_time_")
    e = Engine(spark, now=lambda: NOW)
    stream = AppendStream(e.catalog, "t", f"{at}/table")
    for part in (0, 1):
        rows.where(F.col("event_id") % 2 == part).repartition(3).write.mode("append").parquet(f"{at}/in")
        stream.start(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")).awaitTermination()
    stream.refresh()
    return e.table("t").select(*FIELDS).build()


def stream_window(spark, d):
    """Windows over an appended stream are a matter of the query."""
    at = folder(spark)
    rows = events(spark, d).withColumnRenamed("at", "_time_")
    rows.repartition(3).write.parquet(f"{at}/in")
    e = Engine(spark, now=lambda: NOW)
    stream = AppendStream(e.catalog, "t", f"{at}/table")
    stream.start(spark.readStream.schema(rows.schema).parquet(f"{at}/in")).awaitTermination()
    stream.refresh()
    return e.table("t").select((col("_time_") / DAY).as_("day"), count(v(1)).as_("n"), sum_(col("user_id")).as_("users"), max_(col("event_id")).as_("last")).groupby(1).build()


ALL = f"SELECT * FROM {EVENTS}"
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "source_csv": (source_csv, ALL),
    "source_json": (source_json, ALL),
    "source_json_document": (source_json_document, "SELECT c_custkey, c_name, c_acctbal FROM customer"),
    "source_parquet": (source_parquet, "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(trunc(l_quantity) AS INTEGER) AS l_quantity, CAST(7 AS BIGINT) AS _time_ FROM lineitem"),
    "source_vectors": (source_vectors, "SELECT CAST(n_nationkey AS BIGINT) AS nation_key, n_name AS name FROM nation"),
    "source_sheet": (source_sheet, "SELECT CAST(r_regionkey AS BIGINT) AS key, r_name AS region FROM region"),
    "source_http": (source_http, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation"),
    "source_thrift": (source_thrift, "SELECT p_partkey, p_name, p_brand, CAST(p_size AS INTEGER) AS p_size FROM part"),
    "source_kafka": (source_kafka, ALL),
    "source_synthetic": (source_synthetic, "SELECT CAST(10000 AS BIGINT) AS n"),
    "loader_swap": (loader_swap, f"{ALL} WHERE event_id % 3 = 0"),
    "loader_roll": (loader_roll, f"SELECT event_id, event_type, user_id, value, _time_ // {DAY} * {DAY} AS _time_ FROM {EVENTS} WHERE _time_ >= {1705968000 - 10 * DAY} AND _time_ < {1705968000 + DAY}"),
    "loader_template": (loader_template, f"SELECT event_id, event_type AS kind, event_id // 10 AS tens, _time_ FROM {EVENTS} WHERE event_type IN ('view', 'purchase')"),
    "loader_bucket": (loader_api, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 7"),
    "retention": (retention, f"{ALL} WHERE _time_ >= 1705320000"),
    "partition_cube": (partition_cube, f"{ALL} WHERE event_type = 'purchase'"),
    "time_to_live": (time_to_live, "SELECT name, n FROM (SELECT unnest(['kept', 'renewed']) AS name), (SELECT count(*) AS n FROM region)"),
    "stream_append": (stream_append, ALL),
    "stream_window": (stream_window, f"SELECT _time_ // {DAY} AS day, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users, max(event_id) AS last FROM {EVENTS} GROUP BY 1"),
}
