import pytest

from tidewheel.client import Client, and_, avg, count, eq, from_state, gt, like, or_, p50, sum_, with_wall_clock
from tidewheel.engine import Engine
from tidewheel.errors import FailBuildQuery, MissingTimeRange
from tidewheel.spec import TimeSpec


@pytest.fixture(scope="module")
def client(spark):
    e = Engine(spark, now=lambda: 1000)
    e.catalog.register("t", spark.createDataFrame([(100 + i, i, "xyz"[i % 3]) for i in range(90)], "_time_ long, n long, s string"), TimeSpec("PROVIDED"))
    return Client(e).source("t").time(100, 200)


def test_queries(client):
    rows = client.select("s", p50("n"), avg("n"), count("n"), sum_("n")).where(and_(gt("n", 10), or_(eq("s", "x", "y"), like("s", "z%")))).sortby("DESC").limit(2).run().collect()
    assert [(r.s, r["n.SUM"]) for r in rows] == [("z", 1350), ("y", 1313)]  # the last metric on the column is the one sorted by
    assert client.select("n").sortby("DESC").limit(3).run().collect()[0].n == 89
    assert client.time("-999000m", "now").time(1, "now").range == (1, 1000)
    shaped = client.select("s", count("n")).pivot("s").map({"half": "x / 2"}, "y").timeline(50)
    assert [tuple(r) for r in shaped.orderBy("_window_").collect()] == [(0, 17, 16, 8.5), (50, 13, 14, 6.5)]
    assert with_wall_clock(shaped, 100).orderBy("_window_").first().window_start == 100
    assert client.select("s", "k").apply("k", "LONG", "n % 2").limit(5).run().count() == 5


def test_state(client):
    state = {"table": "t", "start": 100, "end": 200, "keys": ["s"], "metrics": [{"column": "n", "method": 1}], "filter": {"l": "AND", "r": [{"c": "s", "o": 0, "v": ["x"]}, {"l": "OR", "r": [{"c": "n", "o": 2, "v": ["80"]}, {"c": "n", "o": 3, "v": [5]}]}, {"c": "n", "o": 0, "v": []}]}, "sort": 1, "limit": 5}
    assert [tuple(r) for r in from_state(client.engine, state).collect()] == [("x", 0 + 3 + 81 + 84 + 87)]


def test_errors(client):
    with pytest.raises(MissingTimeRange):
        Client(client.engine).source("t").select("s").run()
    for bad in (lambda: client.sortby("UP"), lambda: client.limit(0), lambda: client.select("s", count("n"), sum_("n")).pivot("s"), lambda: client.apply("k", "WHAT", "1")):
        with pytest.raises(FailBuildQuery):
            bad()
