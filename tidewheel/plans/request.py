"""Service requests: what a client sends, checked and turned into a query."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError, FailBuildQuery, MissingOutputFields, MissingTable, TableNotFound
from ..functions import codecs
from ..operators.access import QueryContext
from ..operators.timeline import window_column
from ..schema import TIME, WINDOW
from . import expressions as X
from .query import Query

if TYPE_CHECKING:
    from ..catalog import Catalog, Table

# Names, numbers and defaults of service requests.
DEFAULT_TOP = 100
#: As a request's ``top``: all rows.
ALL_ROWS = -1
#: A tree's smallest count in service requests.
TREE_THRESHOLD = 3
OPERATIONS = ("EQ", "NEQ", "MORE", "LESS", "LIKE", "ILIKE", "UNLIKE", "IUNLIKE")
PERCENTILES = {"P10": 10, "P25": 25, "P50": 50, "P75": 75, "P90": 90, "P99": 99, "P99_9": 99.9, "P99_99": 99.99}
ROLLUPS = ("COUNT", "SUM", "MIN", "MAX", "AVG", *PERCENTILES, "TREEMERGE", "CARD_EST", "HIST")
CUSTOM_KINDS = {"INT": T.IntegerType(), "LONG": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType()}


@dataclass(frozen=True)
class Predicate:
    """``column op value``; several values make EQ an IN and NEQ a NOT IN. ``zip``: delta-coded integers instead of values."""

    column: str
    op: str
    values: Sequence = ()
    zip: bytes | None = None


@dataclass(frozen=True)
class All:
    """All of the conditions, which may nest."""

    of: Sequence


@dataclass(frozen=True)
class Any:
    """Any of the conditions, which may nest."""

    of: Sequence


@dataclass(frozen=True)
class Metric:
    column: str
    method: str


@dataclass(frozen=True)
class Custom:
    column: str
    kind: str
    expr: object
    inputs: Sequence[str] = ()


@dataclass(frozen=True)
class Order:
    column: str
    type: str = "ASC"


@dataclass(frozen=True)
class QueryRequest:
    table: str = ""
    start: int = 0
    end: int = 0
    filter: All | Any | Predicate | None = None
    dimensions: Sequence[str] = ()
    metrics: Sequence[Metric] = ()
    custom: Sequence[Custom] = ()
    order: Order | None = None
    top: int = 0
    timeline: bool = False
    window: int = 0
    time_unit: int = 0
    tz_offset: int = 0
    options: dict = field(default_factory=dict)


def validate(request: QueryRequest, catalog: Catalog) -> Table:
    if not request.table:
        raise MissingTable()
    if not request.dimensions and not request.metrics:
        raise MissingOutputFields()
    if request.table not in catalog:
        raise TableNotFound(request.table)
    return catalog.table(request.table)


def predicate(p: All | Any | Predicate, kinds: dict[str, T.DataType]) -> X.Expr:
    if isinstance(p, All | Any):
        if not p.of:
            raise FailBuildQuery("an empty group of conditions")
        out = predicate(p.of[0], kinds)
        for q in p.of[1:]:
            out = X.Logical("and" if isinstance(p, All) else "or", out, predicate(q, kinds))
        return out
    if p.op not in OPERATIONS:
        raise FailBuildQuery(f"operation {p.op!r}")
    if p.column not in kinds:
        raise FailBuildQuery(f"no column {p.column!r}")
    kind, column = kinds[p.column], X.Col(p.column)
    values = [_constant(v, kind) for v in (codecs.delta_decode(p.zip) if p.zip else p.values)]
    if not values:
        raise FailBuildQuery(f"a condition on {p.column!r} without a value")
    if p.op in ("EQ", "NEQ"):
        if len(values) > 1:
            return X.In(column, values, p.op == "NEQ")
        return X.Compare("==" if p.op == "EQ" else "!=", column, X.Literal(values[0], kind))
    if len(values) > 1:
        raise FailBuildQuery(f"{p.op} takes one value")
    if p.op in ("MORE", "LESS"):
        return X.Compare(">" if p.op == "MORE" else "<", column, X.Literal(values[0], kind))
    return X.like(column, str(values[0]), case_sensitive=p.op in ("LIKE", "UNLIKE"), opposite=p.op in ("UNLIKE", "IUNLIKE"))


def _constant(value, kind: T.DataType):
    """A request's value in its column's kind."""
    try:
        if isinstance(kind, T.StringType):
            return str(value)
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else str(value).lower() in ("true", "1")
        if isinstance(kind, T.FloatType | T.DoubleType):
            return float(value)
        return int(value)
    except (TypeError, ValueError):
        raise FailBuildQuery(f"{value!r} is no {kind.simpleString()}") from None


def _metric(m: Metric) -> X.Expr:
    column, method = X.Col(m.column), m.method.upper()
    if method in PERCENTILES:
        out = X.pct(column, PERCENTILES[method])
    elif method == "TREEMERGE":
        out = X.tpm(column, TREE_THRESHOLD)
    elif method == "CARD_EST":
        out = X.card(column)
    elif method == "HIST":
        out = X.BoundedHistogram(column)
    elif method in ("COUNT", "SUM", "MIN", "MAX", "AVG"):
        out = {"COUNT": X.count, "SUM": X.sum_, "MIN": X.min_, "MAX": X.max_, "AVG": X.avg}[method](column)
    else:
        raise FailBuildQuery(f"rollup {m.method!r}")
    return out.as_(f"{m.column}.{method}")


class _Window(X.Expr):
    """The bucket of a row's time."""

    name = WINDOW

    def __init__(self, request: QueryRequest):
        self.request = request

    def references(self):
        return {TIME}

    def column(self, scope):
        r = self.request
        return window_column(r.start, r.end, r.window, r.time_unit, r.tz_offset), T.LongType()


def to_query(request: QueryRequest, catalog: Catalog) -> Query:
    """The query of a request. Columns come in this order: window, dimensions, metrics."""
    table = validate(request, catalog)
    try:
        kinds = {f.name: f.dataType for f in table.frame().schema}
        q = Query(table, **request.options).between_times(request.start, request.end)
        for c in request.custom:
            if c.kind not in CUSTOM_KINDS:
                raise FailBuildQuery(f"kind {c.kind!r} of {c.column!r}")
            q = q.apply(c.column, CUSTOM_KINDS[c.kind], c.expr, c.inputs)
            kinds[c.column] = CUSTOM_KINDS[c.kind]
        if request.filter is not None:
            q = q.where(predicate(request.filter, kinds))
        fields: list[X.Expr] = [_Window(request)] if request.timeline else []
        fields += [X.Star() if d == "*" else X.Col(d) for d in request.dimensions]
        if request.timeline:
            window_column(request.start, request.end, request.window, request.time_unit, request.tz_offset)  # refuses a bad range
        names = [WINDOW] * request.timeline + [n for d in request.dimensions for n in (table.columns() if d == "*" else [d])]
        keys = len(names)
        fields += [_metric(m) for m in request.metrics]
        names += [m.column for m in request.metrics]
        q = q.select(*fields)
        if request.metrics or request.timeline:
            q = q.groupby(*range(1, keys + 1))
        if request.timeline:
            return q.sortby(1)
        if request.order is not None and request.order.type != "NONE":
            # from the end, so that a metric on a column comes before the column itself
            found = next((i for i in range(len(names), 0, -1) if names[i - 1] == request.order.column), None)
            if found:
                q = q.sortby(found, request.order.type == "DESC")
        return q.limit(0 if request.top == ALL_ROWS else request.top or DEFAULT_TOP)
    except EngineError:
        raise
    except (TypeError, ValueError, KeyError) as e:
        raise FailBuildQuery(str(e)) from e


def run(request: QueryRequest, catalog: Catalog, context: QueryContext | None = None):
    """The frame of a request."""
    catalog.hit(request.table)
    return to_query(request, catalog).build(context)


def texts(df) -> list:
    """The columns as clients get them: BIGINT and INT128 as strings, which those without 64-bit numbers need."""
    return [F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.LongType | T.DecimalType) else F.col(f"`{f.name}`") for f in df.schema]


def to_json(df):
    """Rows as JSON texts."""
    return df.select(*texts(df)).toJSON()
