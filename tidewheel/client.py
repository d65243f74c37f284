"""A client's query builder, and the plain state that web clients send.

    client = Client(engine)
    client.source("hits").time("-3days", "now").select("page", count("id")).where(eq("country", "fr", "de")).sortby("DESC").limit(10).run()
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .engine import Engine
from .errors import FailBuildQuery, MissingTimeRange
from .functions.timefns import parse_time
from .operators.access import QueryContext
from .operators.transforms import map_columns, pivot, remove
from .plans.request import CUSTOM_KINDS, OPERATIONS, ROLLUPS, All, Any, Custom, Metric, Order, Predicate, QueryRequest

SORTS = ("ASC", "DESC", "NONE")


def and_(*rules) -> All:
    return All(rules)


def or_(*rules) -> Any:
    return Any(rules)


def _rule(op: str) -> Callable[..., Predicate]:
    return lambda column, *values: Predicate(column, op, values)


eq, neq, gt, lt, like, ilike, unlike, iunlike = map(_rule, OPERATIONS)


def _metric(method: str) -> Callable[[str], Metric]:
    return lambda column: Metric(column, method)


count, sum_, min_, max_, avg, p10, p25, p50, p75, p90, p99, p99_9, p99_99, tree, card, hist = map(_metric, ROLLUPS)


@dataclass(frozen=True)
class Client:
    """Each method returns a new builder; ``run`` and ``timeline`` give frames."""

    engine: Engine
    table: str = ""
    range: tuple = (0, 0)
    keys: tuple[str, ...] = ()
    metrics: tuple[Metric, ...] = ()
    rules: All | Any | Predicate | None = None
    customs: tuple[Custom, ...] = ()
    sort: str = "ASC"
    top: int = 100
    pivoted: str = ""
    mapped: Mapping[str, str | Column] = field(default_factory=dict)
    removed: tuple[str, ...] = ()

    def source(self, table: str) -> Client:
        return replace(self, table=table)

    def time(self, start, end) -> Client:
        """Epoch seconds as numbers, or literals: ``now``, ``-3days``, dates in UTC."""
        seconds = lambda x: parse_time(x, self.engine.catalog.now()) if isinstance(x, str) else int(x)
        return replace(self, range=(seconds(start), seconds(end)))

    def select(self, *fields: str | Metric) -> Client:
        return replace(self, keys=(*self.keys, *(f for f in fields if isinstance(f, str))), metrics=(*self.metrics, *(f for f in fields if isinstance(f, Metric))))

    def where(self, rules: All | Any | Predicate) -> Client:
        return replace(self, rules=rules)

    def apply(self, name: str, kind: str, expr, inputs: Sequence[str] = ()) -> Client:
        if not name or kind not in CUSTOM_KINDS:
            raise FailBuildQuery(f"a computed column needs a name and a kind of {tuple(CUSTOM_KINDS)}")
        return replace(self, customs=(*self.customs, Custom(name, kind, expr, inputs)))

    def pivot(self, key: str) -> Client:
        if key not in self.keys or len(self.metrics) != 1:
            raise FailBuildQuery("pivot takes one of the keys and a single metric")
        return replace(self, pivoted=key)

    def map(self, columns: Mapping[str, str | Column], *gone: str) -> Client:
        return replace(self, mapped=columns, removed=gone)

    def sortby(self, sort: str) -> Client:
        if sort not in SORTS:
            raise FailBuildQuery(f"sort {sort!r} isn't one of {SORTS}")
        return replace(self, sort=sort)

    def limit(self, n: int) -> Client:
        if n < 1:
            raise FailBuildQuery("a limit is at least 1")
        return replace(self, top=n)

    def request(self, timeline: bool = False, window: int = 0, time_unit: int = 0, tz_offset: int = 0) -> QueryRequest:
        """Sorted by the first metric, or the first key of samples."""
        if not self.range[0] or not self.range[1]:
            raise MissingTimeRange()
        by = self.metrics[0].column if self.metrics else self.keys[0] if self.keys else None
        order = Order(by, self.sort) if by and self.sort != "NONE" else None
        return QueryRequest(self.table, *self.range, self.rules, self.keys, self.metrics, self.customs, order, self.top, timeline, window, time_unit, tz_offset)

    def run(self, timeline: bool = False, window: int = 0, context: QueryContext | None = None, **more) -> DataFrame:
        df = self.engine.query(self.request(timeline, window, **more), context)
        if self.pivoted:
            m = self.metrics[0]
            df = pivot(df, self.pivoted, f"{m.column}.{m.method}")
        if self.mapped:
            df = map_columns(df, self.mapped)
        return remove(df, *self.removed) if self.removed else df

    def timeline(self, window: int = 0, **more) -> DataFrame:
        return self.run(True, window, **more)


def with_wall_clock(df: DataFrame, start: int, window: str = "_window_", name: str = "window_start") -> DataFrame:
    """A timeline's buckets as epoch seconds."""
    return df.withColumn(name, F.col(window) + F.lit(int(start)))


def _rules(node: Mapping | None):
    """A filter of a state: ``{"l": "AND", "r": [{"c": column, "o": operation, "v": values}, {"l": ..., "r": ...}]}``."""
    if not node or not node.get("r"):
        return None
    parts = []
    for r in node["r"]:
        if "l" in r:
            parts.append(_rules(r))
        elif r.get("v"):
            op = r["o"]
            parts.append(Predicate(r["c"], OPERATIONS[op] if isinstance(op, int) else op, r["v"]))
    parts = [p for p in parts if p is not None]
    if not parts:
        return None
    return (Any if str(node.get("l", "AND")).upper() == "OR" else All)(parts)


def from_state(engine: Engine, state: Mapping) -> DataFrame:
    """The frame of a web client's state."""
    of = lambda value, names: names[value] if isinstance(value, int) else str(value)
    kinds = tuple(CUSTOM_KINDS)
    client = Client(engine).source(state.get("table", "")).time(state.get("start", 0), state.get("end", 0)).select(*state.get("keys") or ())
    client = client.select(*(Metric(m.get("C", m.get("column")), of(m.get("M", m.get("method")), ROLLUPS)) for m in state.get("metrics") or ()))
    for c in state.get("customs") or ():
        client = client.apply(c["name"], of(c["type"], kinds), c["expr"])
    if rules := _rules(state.get("filter")):
        client = client.where(rules)
    client = client.sortby(of(state.get("sort", "ASC"), SORTS)).limit(int(state.get("limit") or 100))
    if state.get("pivot"):
        client = client.pivot(state["pivot"])
    return client.run(bool(state.get("timeline")), int(state.get("window") or 0), time_unit=int(state.get("time_unit") or 0))
