import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewheel import macros
from tidewheel.catalog import with_time
from tidewheel.functions.timefns import parse_time, round_time, spark_pattern, time_column
from tidewheel.operators.timeline import Buckets, buckets
from tidewheel.spec import TimeSpec, snap_minutes

NOW = 1_700_000_000
WHEN = int(dt.datetime(2023, 11, 9, 7, 8, 5, tzinfo=dt.timezone.utc).timestamp())
PARTS = {"date": "2023-11-09", "hour": "07", "minute": "08", "second": "05"}
KINDS = ["DAILY", "HOURLY", "MINUTELY", "SECONDLY"]


def subsets():
    return [[p for i, p in enumerate(PARTS) if k >> i & 1] for k in range(16)]


@pytest.mark.parametrize("used", subsets(), ids="-".join)
def test_granularity(used):
    """A path may use the first macros in order, and no later one without all before it."""
    whole = used == list(PARTS)[: len(used)]
    expected = "NONE" if not used else KINDS[len(used) - 1] if whole else "INVALID"
    for path in ("hdfs://name/" + "/".join("{%s}" % p for p in used), "/logs-" + ".".join("{%s}" % p.upper() for p in reversed(used)) + "/part", "/a/" + "".join("%%7B%s%%7D" % p for p in used)):
        assert macros.granularity(path) == expected
        assert macros.granularity(path + "/{timestamp}") == ("INVALID" if used else "TIMESTAMP")
        assert macros.granularity(path + "/{other}") == expected


@pytest.mark.parametrize("depth", range(5))
def test_materialize(depth):
    """A granularity fills in its own macros and those before it."""
    path = "gs://logs/{Date}/h{HOUR}/{minute}_{second}.{other}"
    filled = [PARTS[p] if i < depth else None for i, p in enumerate(PARTS)]
    expected = "gs://logs/{}/h{}/{}_{}.{{other}}".format(*(f or raw for f, raw in zip(filled, ("{Date}", "{HOUR}", "{minute}", "{second}"), strict=True)))
    assert macros.materialize(([None, *KINDS])[depth] or "NONE", path, WHEN) == expected
    assert macros.materialize("TIMESTAMP", "/x/{TimeStamp}/{date}", WHEN) == f"/x/{WHEN}/{{date}}"


def test_time_of_path(spark):
    files = ["file:/mnt/in%20put/eu/2023-11-09/h07.d/x.parquet", "s3a://b/us/2023-11-10/h23.d/y", "s3a://b/us/what/h1.d/y"]
    df = spark.createDataFrame([(f,) for f in files], "f string")
    got = [r[0] for r in df.select(macros.time_of_path("/mnt/in put/{Region}/{date}/h{HOUR}.d", F.col("f"))).collect()]
    hour = WHEN - WHEN % 3600
    assert got == [hour, hour + 40 * 3600, None]
    assert macros.wildcards("/a/{Region}/%7Bdate%7D/{HOUR}") == "/a/{Region}/*/*"


def test_roll_and_expand():
    got = list(macros.roll("/in/{date}.{hour}", WHEN, 3 * 3600))
    assert got == [(f"/in/2023-11-09.{h:02d}", WHEN - WHEN % 3600 - (7 - h) * 3600) for h in (7, 6, 5)]
    assert list(macros.roll("/in/{date}", WHEN, 86400)) == [("/in/2023-11-09", WHEN - WHEN % 86400)]
    assert len(list(macros.roll("/in/{date}{hour}{minute}{second}", NOW, 7))) == 8  # a step of one second
    with pytest.raises(ValueError):
        list(macros.roll("/in/{timestamp}", NOW, 100))
    assert list(macros.expand("/{Region}/%7Bkind%7D/{date}", {"region": ["eu", "us"], "kind": ["hits"], "unused": ["no"]})) == [(f"/{r}/hits/{{date}}", {"region": r, "kind": "hits"}) for r in ("eu", "us")]


@pytest.mark.parametrize(
    "literal,seconds",
    [(None, 0), (WHEN * 1000, WHEN), (str(WHEN * 1000), WHEN), ("now", NOW), ("-2days", NOW - 2 * 86400), ("-40m", NOW - 2400), ("-1wk", NOW - 7 * 86400), ("-6h", NOW - 6 * 3600), ("2023-11-09 07:08:05", WHEN), ("2023-11-09", WHEN - WHEN % 86400), ("2023-11-09T12:38:05+05:30", WHEN)],
)
def test_literals(literal, seconds):
    assert parse_time(literal, NOW) == seconds


def test_bad_literal():
    with pytest.raises(ValueError):
        parse_time("some day", NOW)


@pytest.mark.parametrize("pattern,expected", [("%d.%m.%y %I:%M %p", "dd.MM.yy hh:mm a"), ("%Y/%j", "yyyy/DDD"), ("at %Hh%%", "'at' HH'h%'"), ("it's %b", "'it''s' MMM")])
def test_patterns(pattern, expected):
    assert spark_pattern(pattern) == expected


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_time_columns(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("09.11.2023 07:08:05", WHEN * 1000 + 999, 45239.5, "2023-11-09T07:08:05Z"), ("never", -5, 25569.0, "?"), (None, None, None, None)], "s string, ms long, serial double, iso string")
        got = df.select(time_column(F.col("s"), "%d.%m.%Y %H:%M:%S"), time_column(F.col("ms"), "UNIXTIME_MS"), time_column(F.col("serial"), "SERIAL_NUMBER"), time_column(F.col("iso"), "iso8601"), time_column(F.col("ms"), "UNIXTIME")).collect()
        noon = WHEN - WHEN % 86400 + 43200
        assert [tuple(r) for r in got] == [(WHEN, WHEN, noon, WHEN, WHEN * 1000 + 999), (0, 0, 0, 0, -5), (1, 1, 1, 1, 1)]
        rounded = spark.createDataFrame([(WHEN,)], "t long").select(*(round_time(F.col("t"), u) for u in ("hour", "day", "week", "month", "quarter", "year"))).first()
        day = lambda *d: int(dt.datetime(*d, tzinfo=dt.timezone.utc).timestamp())
        assert tuple(rounded) == (day(2023, 11, 9, 7), day(2023, 11, 9), day(2023, 11, 5), day(2023, 11, 1), day(2023, 10, 1), day(2023, 1, 1))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_time_specs(spark):
    df = spark.createDataFrame([(1, "2023-11-09")], "n int, day string")
    assert with_time(df, TimeSpec("STATIC", value=5)).first()["_time_"] == 5
    assert with_time(df, TimeSpec("CURRENT"), now=7).first()["_time_"] == 7
    assert with_time(df, TimeSpec("MACRO"), watermark=9).first()["_time_"] == 9
    column = with_time(df, TimeSpec("COLUMN", column="day", pattern="%Y-%m-%d"))
    assert column.columns == ["n", "_time_"] and column.first()["_time_"] == WHEN - WHEN % 86400
    provided = with_time(df.withColumn("_time_", F.lit(None).cast("int")), TimeSpec("PROVIDED"))
    assert provided.first()["_time_"] == 1


@pytest.mark.parametrize("span,window,expected", [(5000, 0, Buckets(50, 100)), (30, 0, Buckets(1, 30)), (700, 200, Buckets(233, 3)), (700, 900, Buckets(1, 700)), (60, 60, Buckets(60, 1))])
def test_buckets(span, window, expected):
    got = buckets(11, 11 + span, window)
    assert got == expected


def test_bad_range_and_intervals():
    with pytest.raises(ValueError):
        buckets(9, 9)
    steps = (1, 2, 5, 10, 15, 20, 30)
    for m in range(60):
        assert snap_minutes(m) == min((s for s in steps if s >= m), default=30)
