import pytest
from pyspark.sql import functions as F

from tidewheel.catalog import Catalog
from tidewheel.engine import Engine
from tidewheel.errors import EngineError, FailBuildQuery, MissingOutputFields, MissingTable, TableNotFound
from tidewheel.functions.codecs import hash_bucket
from tidewheel.plans.expressions import col, count, v
from tidewheel.plans.request import All, Any, Custom, Metric, Order, Predicate, QueryRequest, to_json, to_query
from tidewheel.spec import ColumnProps, TimeSpec, read_config
from tidewheel.streaming import AppendStream, segments

DAY = 86400


class Clock:
    def __init__(self, now):
        self.now = now

    def __call__(self):
        return self.now


def test_ttl(spark):
    clock = Clock(1000)
    c = Catalog(spark, now=clock)
    c.register("keep", spark.range(1))
    c.register("$brief", spark.range(1), ttl=10)
    clock.now = 1009
    c.hit("$brief")
    clock.now = 1018
    assert c.list() == ["$brief", "keep"] and c.list(1) == ["$brief"]
    clock.now = 1020
    assert "$brief" not in c
    with pytest.raises(TableNotFound):
        c.table("$brief")
    c.unload("keep")
    with pytest.raises(TableNotFound):
        c.unload("keep")


def test_snapshots(spark, tmp_path):
    clock = Clock(30 * DAY)
    c = Catalog(spark, str(tmp_path), clock)
    df = spark.createDataFrame([(i * DAY // 2, "abc"[i % 3], i) for i in range(60)], "_time_ long, tag string, n int")
    props = {"tag": ColumnProps(dict=True, bloom_filter=True, partition_values=("a", "b", "c"), partition_chunk=2)}
    c.publish("t", df, props)
    t = c.open("t")
    assert t.columns() == ["_time_", "tag", "n"] and t.frame().count() == 60
    old = t.frame()
    e = Engine(spark)
    e.catalog = c
    got = e.table("t").between_times(10 * DAY, 12 * DAY).select(count(v(1)).as_("n")).build()
    assert got.first().n == 5
    assert "PartitionFilters: [isnotnull(_date_" in got._jdf.queryExecution().toString()
    clock.now += 10
    c.retain("t", 5 * DAY)
    assert c.table("t").frame().count() == 9 and old.count() == 60  # readers of the old snapshot go on
    days = lambda: sorted(p.name for p in (tmp_path / "t" / c.current("t")).glob("_date_=*"))
    assert len(days()) == 30 and c.vacuum("t") == [] and days() == [f"_date_=1970-01-{d}" for d in range(26, 31)]
    clock.now += 10
    c.publish("t", df.limit(3))
    assert c.open("t").frame().count() == 3
    assert len(c.vacuum("t", keep=1)) == 1 and c.open("t").frame().count() == 3
    assert [p.name for p in (tmp_path / "t").glob("manifest-*")] == ["manifest-000000000003"]
    with pytest.raises(Exception, match="outside the partition"):
        c.publish("bad", df, {"tag": ColumnProps(partition_values=("a", "b"))})
    with pytest.raises(TableNotFound):
        c.open("nothing")


def test_retention_keeps_what_is_ahead(spark, tmp_path):
    c = Catalog(spark, str(tmp_path), Clock(10 * DAY))
    c.publish("t", spark.createDataFrame([(DAY, 1), (10 * DAY, 2), (510 * DAY, 3), (40_000 * DAY, 4), (8 * DAY + 5, 5), (8 * DAY - 5, 6)], "_time_ long, n int"))
    c.retain("t", 2 * DAY)
    assert sorted(r.n for r in c.table("t").frame().collect()) == [2, 3, 4, 5]
    c.retain("t", 1000 * DAY)  # what was given up doesn't come back
    c.vacuum("t")
    assert sorted(r.n for r in Catalog(spark, str(tmp_path)).open("t").frame().collect()) == [2, 3, 4, 5]
    with pytest.raises(TableNotFound):
        c.retain("nothing", 5)


def test_manifests_never_leave_a_gap(spark, tmp_path):
    c = Catalog(spark, str(tmp_path), Clock(0))
    first = c.publish("t", spark.range(1).selectExpr("0L _time_"))
    (tmp_path / "t" / ".manifest-left-by-a-crash").write_text("{")
    assert c.current("t") == first
    second = c.publish("t", spark.range(2).selectExpr("0L _time_"))
    assert c.current("t") == second and c.open("t").frame().count() == 2


def test_chunks_are_pruned(spark, tmp_path):
    c = Catalog(spark, str(tmp_path), Clock(0))
    df = spark.createDataFrame([(0, "abcde"[i % 5], i) for i in range(50)], "_time_ long, tag string, n int")
    props = {"tag": ColumnProps(partition_values=tuple("abcde"), partition_chunk=2)}
    c.publish("t", df, props)
    e = Engine(spark)
    e.catalog = c
    c.register("t", spark.read.parquet(f"{tmp_path}/t/{c.current('t')}"), columns=props)
    from tidewheel.plans.expressions import in_

    for condition, expected, pruned in ((col("tag") == "c", 10, True), (in_(col("tag"), ["a", "e"]) & (col("n") > 4), 18, True), (col("tag") == "z", 0, False), ((col("tag") == "a") | (col("n") > 40), 18, False)):
        q = e.table("t").where(condition).select(col("n")).build()
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert ("PartitionFilters: [_chunk_tag" in plan or "PartitionFilters: [isnotnull(_chunk_tag" in plan) == pruned and ("FileScan" in plan) == (expected != 0)
        assert q.count() == expected
    # a computed column of the same name doesn't choose chunks
    from pyspark.sql import types as T

    assert e.table("t").apply("tag", T.StringType(), "'c'").where(col("tag") == "c").select(col("n")).build().count() == 50


CONFIG = """
tables:
  web.hits:
    retention: {max-mb: 100, max-hr: 48}
    schema: "ROW<n:int, s:string, part:string, secret:string>"
    data: local
    loader: Roll
    source: ROOT/%7Bpart%7D/{date}/hits.csv
    format: csv
    csv: {hasHeader: true, delimiter: ","}
    time: {type: macro, pattern: daily}
    macros: {part: [p1, p2]}
    columns:
      part: {from_macro: part}
      s: {default_value: none, dict: true}
      secret: {access: {read: {groups: [g], action: mask}}}
    access: {aggregation: {groups: [g], action: deny}}
    settings: {batch: 500}
    headers: ["a: b"]
    bucket: {size: 100, column: n}
"""


def test_config(spark, tmp_path):
    pytest.importorskip("yaml")
    spec = read_config(CONFIG)["web.hits"]
    assert spec.max_seconds == 48 * 3600 and spec.format == "CSV" and spec.csv.has_meta is False and spec.bucket.size == 100
    assert spec.columns["secret"].rules and spec.rules and spec.macros == {"part": ("p1", "p2")} and spec.settings == {"batch": "500"}
    now = 1611708922  # 2021-01-27
    for part, days in (("p1", ("27", "26")), ("p2", ("27",))):
        for d in days:
            folder = tmp_path / part / f"2021-01-{d}"
            folder.mkdir(parents=True)
            (folder / "hits.csv").write_text(f"n,s,secret\n{int(d)},x,y\n")
    c = Catalog(spark, now=Clock(now))
    assert c.add_yaml(CONFIG.replace("ROOT", str(tmp_path))) == ["web.hits"]
    got = c.load("web.hits").frame()
    assert sorted((r.n, r.part, r["_time_"]) for r in got.collect()) == [(26, "p1", 1611619200), (27, "p1", 1611705600), (27, "p2", 1611705600)]
    name = c.load_template("web.hits", {"part": "p2"})
    assert name.startswith("$web.hits-") and c.table(name).frame().count() == 1 and c.load_template("web.hits", {"part": "p2"}) == name
    for broken in ("time: {type: what}", "format: what", "data: what"):
        with pytest.raises(ValueError):
            key = broken.split(":")[0]
            read_config("\n".join(f"    {broken}" if line.strip().startswith(key + ":") else line for line in CONFIG.splitlines()))


def test_demand(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1, "t": "2020-07-07"}\n{"a": 2, "t": "bad"}\n')
    c = Catalog(spark, str(tmp_path / "root"))
    request = {"schema": "ROW<a:int, t:string>", "source": str(tmp_path / "x.json"), "format": "json", "time": {"type": "column", "column": "t", "pattern": "%Y-%m-%d"}}
    name = c.load_demand(request)
    assert name.startswith("$") and sorted(tuple(r) for r in c.table(name).frame().collect()) == [(1, 1594080000), (2, 0)]
    assert c.load_demand(request) == name
    made = c.load_demand({**request, "schema": "ROW<a:int, t:string, b:bigint>", "columns": {"b": {"expr": "a * 10"}}})
    assert sorted(tuple(r) for r in c.table(made).frame().select("a", "b").collect()) == [(1, 10), (2, 20)]
    with pytest.raises(FileNotFoundError):
        c.load_demand({**request, "source": str(tmp_path / "nothing.json")})


def murmur3(value, seed=42):
    """Murmur3 of the eight bytes of a long, as 32 bits with a sign."""
    mask, h = 0xFFFFFFFF, seed
    turn = lambda x, r: (x << r | x >> 32 - r) & mask
    for word in (value & mask, value >> 32 & mask):
        h = (turn(h ^ turn(word * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask, 13) * 5 + 0xE6546B64) & mask
    h ^= 8
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_hash_bucket(spark):
    values = [0, 1, -1, 7_777_777_777, -(1 << 63), (1 << 63) - 1, *range(10**6, 10**6 + 40)]
    got = spark.createDataFrame([(x,) for x in values], "v long").select(hash_bucket(F.col("v"), 1000)).collect()
    assert [r[0] for r in got] == [murmur3(x) % 1000 for x in values]


def test_requests(spark):
    e = Engine(spark)
    e.catalog.register("t", spark.createDataFrame([(i, i % 3, "xyz"[i % 3], i / 2) for i in range(100)], "n long, k int, s string, f double"), TimeSpec("STATIC", value=50))
    ok = QueryRequest("t", 0, 100, None, ["s"], [Metric("n", "SUM"), Metric("n", "COUNT"), Metric("f", "P50"), Metric("n", "CARD_EST"), Metric("f", "HIST"), Metric("s", "TREEMERGE")], order=Order("n", "DESC"))
    rows = e.query(ok).collect()
    assert [r["s"] for r in rows] and rows[0]["n.COUNT"] == 34 and len(rows) == 3
    assert [r["s"] for r in e.query(QueryRequest("t", 0, 100, Any([Predicate("s", "EQ", ["x"]), Predicate("k", "MORE", ["1"])]), ["s"], [Metric("n", "COUNT")], order=Order("s", "ASC"))).collect()] == ["x", "z"]
    assert e.query(QueryRequest("t", 0, 100, All([Predicate("s", "NEQ", ["x", "y"]), Predicate("s", "IUNLIKE", ["Y%"])]), ["n"])).count() == 33
    assert e.query(QueryRequest("t", 0, 49, None, ["n"])).count() == 0
    assert e.query(QueryRequest("t", 0, 100, None, ["*"])).count() == 100  # the default limit
    assert e.query(QueryRequest("t", 0, 100, Predicate("big", "MORE", [5]), ["big"], custom=[Custom("big", "INT", "k * 3")], top=7)).count() == 7
    texts = to_json(e.query(QueryRequest("t", 0, 100, Predicate("n", "EQ", [5]), ["n", "k"]))).collect()
    assert texts == ['{"n":"5","k":2}']
    for bad, error in (
        (QueryRequest(), MissingTable), (QueryRequest("t"), MissingOutputFields), (QueryRequest("what", dimensions=["a"]), TableNotFound), (QueryRequest("t", 0, 1, Predicate("what", "EQ", [1]), ["n"]), FailBuildQuery),
        (QueryRequest("t", 0, 1, Predicate("n", "EQ", []), ["n"]), FailBuildQuery), (QueryRequest("t", 0, 1, Predicate("n", "EQ", ["x"]), ["n"]), FailBuildQuery), (QueryRequest("t", 0, 1, None, ["n"], [Metric("n", "WHAT")]), FailBuildQuery),
        (QueryRequest("t", 5, 5, None, ["n"], timeline=True), FailBuildQuery), (QueryRequest("t", 0, 1, Predicate("n", "LIKE", ["a", "b"]), ["n"]), FailBuildQuery),
    ):
        with pytest.raises(error) as caught:
            to_query(bad, e.catalog)
        assert isinstance(caught.value, EngineError) and caught.value.code == error.code


def test_state(spark):
    e = Engine(spark)
    df = spark.createDataFrame([(1, "a", True, 2.5, [1]), (3, "b", False, 0.5, [2])], "n int, s string, b boolean, f double, l array<int>").withColumn("_time_", F.col("n").cast("long") * 100)
    t = e.catalog.register("t", df)
    state = t.state().first()
    assert (state.rows, state.min_time, state.max_time, state.dimensions, state.metrics) == (2, 100, 300, ["s"], ["n", "b", "f", "_time_"])
    assert state.bytes == state.blocks == 0 and {h.column for h in state.histograms} == {"n", "s", "b", "f", "l", "_time_"}
    assert {r.column: r.histogram for r in t.histograms().collect()}["b"] == '{"count":2,"trues":1}'


def test_stats(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(1000).selectExpr("id n", "id % 3 k", "id _time_").repartition(4).write.parquet(path)
    e = Engine(spark)
    state = e.catalog.register("t", spark.read.parquet(path)).state().first()
    assert state.blocks == 4 and state.bytes == sum(f.stat().st_size for f in (tmp_path / "p").glob("*.parquet"))
    answer = e.answer(QueryRequest("t", 0, 499, None, ["k"], [Metric("n", "COUNT")], order=Order("k", "ASC")))
    assert answer.rows == ['{"k":"0","n.COUNT":"167"}', '{"k":"1","n.COUNT":"167"}', '{"k":"2","n.COUNT":"166"}']
    assert answer.rows_scanned == 1000 and answer.blocks == 4 and answer.bytes > 0 and answer.ms > 0


def test_time_ranges_reach_the_file(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("select id n, timestamp_ntz'2020-01-01 00:00:00.5' + make_interval(0, 0, 0, id) ts from range(10)").write.parquet(path)
    e = Engine(spark)
    from tidewheel.functions.timefns import wall_seconds

    df = spark.read.parquet(path)
    e.catalog.register("t", df.withColumn("_time_", wall_seconds(F.col("ts"))), time_from="ts")
    q = e.table("t").between_times(1577836800 + 2 * DAY, 1577836800 + 4 * DAY).select(col("n")).build()
    assert sorted(r.n for r in q.collect()) == [2, 3, 4]
    assert "GreaterThanOrEqual(ts" in q._jdf.queryExecution().toString()


def test_segments():
    assert list(segments(5, 35, 10)) == [(5, 10), (10, 20), (20, 30)]
    assert list(segments(0, 9, 10)) == []


def test_append_stream(spark, tmp_path):
    c = Catalog(spark, now=Clock(20 * DAY))
    schema = "_time_ long, n int"
    source = str(tmp_path / "in")
    spark.createDataFrame([(DAY, 1), (0, 2), (19 * DAY, 3)], schema).coalesce(1).write.parquet(source)
    stream = AppendStream(c, "s", str(tmp_path / "table"))
    read = lambda: spark.readStream.schema(schema).parquet(source)
    stream.start(read()).awaitTermination()
    assert sorted(r.n for r in stream.refresh().frame().collect()) == [1, 3]  # rows without a time are dropped
    spark.createDataFrame([(19 * DAY + 5, 4)], schema).coalesce(1).write.mode("append").parquet(source)
    stream.start(read()).awaitTermination()
    stream.start(read()).awaitTermination()
    e = Engine(spark)
    e.catalog = c
    stream.refresh()
    assert e.table("s").between_times(19 * DAY, 20 * DAY).select(count(v(1)).as_("n")).build().first().n == 2
    assert stream.retain(5 * DAY) == 1
    assert sorted(r.n for r in stream.refresh().frame().collect()) == [3, 4]
    assert e.table("s").select(col("n")).build().count() == 2


def test_a_stream_is_read_in_another_process(spark, tmp_path):
    schema = "_time_ long, n int"
    source = str(tmp_path / "in")
    spark.createDataFrame([(DAY, 1)], schema).write.parquet(source)
    AppendStream(Catalog(spark), "s", str(tmp_path / "table")).start(spark.readStream.schema(schema).parquet(source)).awaitTermination()
    assert AppendStream(Catalog(spark), "s", str(tmp_path / "table")).refresh().frame().count() == 1


def test_kafka_specs(spark):
    asked = []

    def reader(options):
        asked.append(dict(options))
        return spark.createDataFrame([(bytearray(b'{"id": "a", "k": 5}'), 70), (bytearray(b'{"id": "b"}'), 80)], "value binary, s long").select("value", F.timestamp_seconds("s").alias("timestamp"))

    c = Catalog(spark, now=Clock(1000), kafka=reader)
    config = {"schema": "ROW<id:string, n:int>", "data": "kafka", "loader": "Streaming", "source": "one:9092,two:9092", "format": "json", "kafka": {"topic": "orders", "topic-retention": 600, "size": 250}, "json": {"columnsMap": {"n": "k"}}}
    from tidewheel.spec import table_spec

    c.add_spec(table_spec("orders", config))
    c.load("orders")
    assert sorted(tuple(r) for r in c.table("orders").frame().collect()) == [("a", 5, 70), ("b", 0, 80)]
    assert asked[-1]["subscribe"] == "orders" and asked[-1]["kafka.bootstrap.servers"] == "one:9092,two:9092" and asked[-1]["startingTimestamp"] == "400000" and asked[-1]["endingOffsets"] == "latest"
    c.add_spec(table_spec("segment", {**config, "settings": {"k.partition": 3, "k.offset": 1_100}}))
    c.load("segment")
    assert asked[-1]["assign"] == '{"orders": [3]}' and asked[-1]["startingOffsets"] == '{"orders": {"3": 1000}}' and asked[-1]["endingOffsets"] == '{"orders": {"3": 1250}}'
    from tidewheel.streaming import kafka_batches

    kafka_batches(spark, "b", "t", spark.createDataFrame([], "id string").schema, {0: (5, 35), 1: (2, 9)}, size=10, reader=reader)
    assert asked[-1]["startingOffsets"] == '{"t": {"0": 5, "1": 2}}' and asked[-1]["endingOffsets"] == '{"t": {"0": 30, "1": 2}}'


def test_rolls_are_one_scan(spark, tmp_path):
    from tidewheel.spec import table_spec

    now = 1_717_250_645  # 2024-06-01 14:04:05
    for day, hour in (("2024-06-01", "14"), ("2024-06-01", "13"), ("2024-05-31", "20"), ("2024-05-29", "20")):
        spark.createDataFrame([(f"{day} {hour}",)], "at string").write.parquet(str(tmp_path / "x y" / day / f"h{hour}"))
    c = Catalog(spark, now=Clock(now))
    c.add_spec(table_spec("r", {"schema": "ROW<at:string>", "source": f"{tmp_path}/x y/{{date}}/h{{hour}}", "loader": "Roll", "format": "parquet", "time": {"type": "macro"}, "retention": {"max-hr": 24}}))
    c.load("r")
    df = c.table("r").frame()
    hour = now - now % 3600
    assert sorted(tuple(r) for r in df.collect()) == [("2024-05-31 20", hour - 18 * 3600), ("2024-06-01 13", hour - 3600), ("2024-06-01 14", hour)]
    e = Engine(spark)
    e.catalog = c
    q = e.table("r").between_times(hour - 3600, hour).select(col("at")).build()
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert q.count() == 2 and plan.count("FileScan") == 1


def test_stored_times_reach_the_file(spark, tmp_path):
    from tidewheel.spec import table_spec

    spark.range(100).selectExpr("id n", "id * 1000 + 7 ms").write.parquet(str(tmp_path / "p"))
    c = Catalog(spark)
    c.add_spec(table_spec("t", {"schema": "ROW<n:bigint, ms:bigint>", "source": str(tmp_path / "p"), "format": "parquet", "time": {"type": "column", "column": "ms", "pattern": "UNIXTIME_MS"}}))
    assert c.load("t").columns() == ["n", "_time_"]
    e = Engine(spark)
    e.catalog = c
    q = e.table("t").between_times(10, 12).select(col("n")).build()
    assert sorted(r.n for r in q.collect()) == [10, 11, 12] and "GreaterThanOrEqual(ms,10000)" in q._jdf.queryExecution().toString()
    assert e.table("t").select(col("*")).build().columns == ["n", "_time_"]
