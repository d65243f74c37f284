"""The fluent expressions of a query. They know their table only when a query is built."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arithmetic, codecs, patterns, timefns
from ..operators import aggregates
from ..schema import is_numeric, zero
from .scripts import check_sql

#: Lists longer than this are joined rather than compared value by value.
IN_LIST = 1000


@dataclass
class Scope:
    """What an expression is built against: the frame, and whether nulls read as defaults in results."""

    df: DataFrame
    null_as_default: bool = False

    def kind(self, name: str) -> T.DataType:
        for f in self.df.schema:
            if f.name == name:
                return f.dataType
        raise KeyError(f"no column {name!r}")


class Expr:
    """An expression; ``column`` gives it and its kind."""

    name: str | None = None

    def column(self, scope: Scope) -> tuple[Column, T.DataType]:
        raise NotImplementedError

    def children(self) -> Sequence[Expr]:
        return ()

    def references(self) -> set[str]:
        """Names of the columns it has; those of scripts are known only once they are resolved."""
        return set().union(*(c.references() for c in self.children()))

    def scripts(self) -> list[Script]:
        """The scripts in it."""
        return [s for c in self.children() for s in c.scripts()]

    @property
    def is_aggregate(self) -> bool:
        return any(c.is_aggregate for c in self.children())

    def as_(self, name: str) -> Expr:
        self.name = name
        return self

    alias = as_

    def _op(self, op: str, other, swap: bool = False) -> Expr:
        a, b = (lift(other), self) if swap else (self, lift(other))
        return Binary(op, a, b)

    def __add__(self, other): return self._op("+", other)
    def __radd__(self, other): return self._op("+", other, True)
    def __sub__(self, other): return self._op("-", other)
    def __rsub__(self, other): return self._op("-", other, True)
    def __mul__(self, other): return self._op("*", other)
    def __rmul__(self, other): return self._op("*", other, True)
    def __truediv__(self, other): return self._op("/", other)
    def __rtruediv__(self, other): return self._op("/", other, True)
    def __mod__(self, other): return self._op("%", other)
    def __rmod__(self, other): return self._op("%", other, True)
    def __eq__(self, other): return Compare("==", self, lift(other))  # type: ignore[override]
    def __ne__(self, other): return Compare("!=", self, lift(other))  # type: ignore[override]
    def __gt__(self, other): return Compare(">", self, lift(other))
    def __ge__(self, other): return Compare(">=", self, lift(other))
    def __lt__(self, other): return Compare("<", self, lift(other))
    def __le__(self, other): return Compare("<=", self, lift(other))
    def __and__(self, other): return Logical("and", self, lift(other))
    def __or__(self, other): return Logical("or", self, lift(other))
    def __invert__(self): return Not(self)
    __hash__ = object.__hash__


@dataclass(eq=False)
class Col(Expr):
    source: str

    def __post_init__(self):
        self.name = self.source

    def column(self, scope):
        return F.col(f"`{self.source}`"), scope.kind(self.source)

    def references(self):
        return {self.source}


@dataclass(eq=False)
class Star(Expr):
    """All columns of the table, in place."""


@dataclass(eq=False)
class Literal(Expr):
    value: object
    kind: T.DataType | None = None

    def column(self, scope):
        kind = self.kind or literal_kind(self.value)
        return F.lit(self.value).cast(kind), kind


def literal_kind(value) -> T.DataType:
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.IntegerType() if -(1 << 31) <= value < 1 << 31 else T.LongType() if -(1 << 63) <= value < 1 << 63 else T.DecimalType(38, 0)
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    raise TypeError(f"{value!r} can't be a literal")


def lift(value) -> Expr:
    return value if isinstance(value, Expr) else Literal(value)


@dataclass(eq=False)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    def __post_init__(self):
        self.name = self.left.name

    def children(self):
        return (self.left, self.right)

    def column(self, scope):
        return arithmetic.combine(self.op, *self.left.column(scope), *self.right.column(scope))


@dataclass(eq=False)
class Compare(Expr):
    op: str
    left: Expr
    right: Expr

    def __post_init__(self):
        self.name = self.left.name

    def children(self):
        return (self.left, self.right)

    def column(self, scope):
        (a, ak), (b, bk) = self.left.column(scope), self.right.column(scope)
        same = isinstance(ak, T.StringType) == isinstance(bk, T.StringType) and isinstance(ak, T.BooleanType) == isinstance(bk, T.BooleanType)
        if not same:
            raise TypeError(f"can't compare {ak.simpleString()} and {bk.simpleString()}")
        if isinstance(ak, T.BooleanType) and self.op not in ("==", "!="):
            raise TypeError("booleans have no order")
        out = {"==": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[self.op]
        return out, T.BooleanType()


@dataclass(eq=False)
class Logical(Expr):
    op: str
    left: Expr
    right: Expr

    def children(self):
        return (self.left, self.right)

    def column(self, scope):
        (a, ak), (b, bk) = self.left.column(scope), self.right.column(scope)
        if not (isinstance(ak, T.BooleanType) and isinstance(bk, T.BooleanType)):
            raise TypeError(f"{self.op} takes booleans")
        return (a & b if self.op == "and" else a | b), T.BooleanType()


@dataclass(eq=False)
class Not(Expr):
    inner: Expr

    def children(self):
        return (self.inner,)

    def column(self, scope):
        a, kind = self.inner.column(scope)
        if not isinstance(kind, T.BooleanType):
            raise TypeError("not takes a boolean")
        return ~a, kind


@dataclass(eq=False)
class Function(Expr):
    """A function of one expression: ``make`` gets its column and kind."""

    inner: Expr
    make: Callable[[Column, T.DataType, Scope], tuple[Column, T.DataType]]

    def __post_init__(self):
        self.name = self.inner.name

    def children(self):
        return (self.inner,)

    def column(self, scope):
        return self.make(*self.inner.column(scope), scope)


@dataclass(eq=False)
class In(Expr):
    """Whether a value is in a list. Of null, neither IN nor NOT IN holds."""

    inner: Expr
    values: list
    negated: bool = False

    def children(self):
        return (self.inner,)

    @property
    def is_long(self) -> bool:
        return len(self.values) > IN_LIST

    def column(self, scope):
        a, _ = self.inner.column(scope)
        out = a.isin(self.values)
        return (~out if self.negated else out), T.BooleanType()


@dataclass(eq=False)
class Aggregate(Expr):
    """An aggregate of one expression: ``make`` gets its column and kind."""

    inner: Expr
    function: str
    make: Callable[[Column, T.DataType], tuple[Column, T.DataType]]

    def __post_init__(self):
        self.name = self.inner.name or self.function

    def children(self):
        return (self.inner,)

    @property
    def is_aggregate(self):
        return True

    def column(self, scope):
        if self.inner.is_aggregate:
            raise TypeError("an aggregate can't be inside another one")
        x, kind = self.inner.column(scope)
        fill = zero(kind)
        if scope.null_as_default and fill is not None:
            x = F.coalesce(x, F.lit(fill).cast(kind))
        return self.make(x, kind)


@dataclass(eq=False)
class BoundedHistogram(Expr):
    """A histogram between the least and the largest value within the query's time range; they are asked for when it is built, which is after
    the access check."""

    inner: Expr

    def __post_init__(self):
        self.name = self.inner.name

    def children(self):
        return (self.inner,)

    @property
    def is_aggregate(self):
        return True

    def column(self, scope):
        x, kind = self.inner.column(scope)
        low, high = scope.df.agg(F.min(x), F.max(x)).first()
        return hist(self.inner, low or 0, high or 0).column(scope)


@dataclass(eq=False)
class TreeMerge(Expr):
    """Merged stacks; built by the query, since it takes a plan of its own."""

    inner: Expr
    threshold: int = aggregates.TREE_THRESHOLD

    def __post_init__(self):
        self.name = self.inner.name

    def children(self):
        return (self.inner,)

    @property
    def is_aggregate(self):
        return True


class Script(Expr):
    """A computed column: a Spark SQL expression, or a Python function of pandas series over named columns."""

    def __init__(self, name: str, kind: T.DataType, body: str | Callable, inputs: Sequence[str] = ()):
        self.name, self.kind, self.body, self.inputs = name, kind, body, inputs

    def scripts(self):
        return [self]

    def column(self, scope):
        if callable(self.body):
            return F.pandas_udf(self.body, self.kind)(*(F.col(f"`{c}`") for c in self.inputs)), self.kind
        sql = sql_of(self.body)
        check_sql(scope.df.sparkSession, sql)
        return F.expr(sql).try_cast(self.kind), self.kind


_ARROW = re.compile(r"^\s*(?:const\s+\w+\s*=\s*)?\(\s*\)\s*=>\s*(.+?);?\s*$", re.S)
_COLUMN_CALL = re.compile(r"\b\w+\.column\(\s*(['\"])(.*?)\1\s*\)")


def sql_of(body: str) -> str:
    """The SQL of a computed column. A JavaScript arrow function that is one arithmetic or comparison expression over column calls is
    translated; other JavaScript is refused."""
    arrow = _ARROW.match(body)
    if not arrow:
        if "=>" in body and ".column(" in body:
            raise ValueError("only one-expression arrow functions can be translated; use SQL or Python")
        return body
    parts, last, out = [], 0, arrow[1]
    for m in _COLUMN_CALL.finditer(out):
        parts += [out[last : m.start()], "`" + m[2] + "`"]
        last = m.end()
    rest = "".join(parts[::2]) + out[last:]
    if re.search(r"[;{}\[\]?:'\"`]|=>|\b(?:let|var|const|return|function|new)\b", rest):
        raise ValueError("only one-expression arrow functions can be translated; use SQL or Python")
    text = "".join(parts) + out[last:]
    return text.replace("===", "=").replace("!==", "<>").replace("==", "=").replace("&&", " and ").replace("||", " or ")


# what users write

def col(name: str) -> Expr:
    return Star() if name == "*" else Col(name)


def v(value, kind: T.DataType | None = None) -> Expr:
    return Literal(value, kind)


def reverse(e) -> Expr:
    return Not(lift(e))


def in_(e, values) -> Expr:
    return In(lift(e), _values(values))


def nin(e, values) -> Expr:
    return In(lift(e), _values(values), True)


def _values(values) -> list:
    """A list, or delta-coded bytes of 8-byte integers."""
    return codecs.delta_decode(bytes(values)) if isinstance(values, bytes | bytearray) else list(values)


def between(e, low, high) -> Expr:
    def make(x, kind, _):
        if not is_numeric(kind):
            raise TypeError("between takes numbers")
        return x.between(F.lit(low), F.lit(high)), T.BooleanType()

    return Function(lift(e), make)


def _text(name: str, make) -> Callable:
    def checked(x, kind, scope):
        if not isinstance(kind, T.StringType):
            raise TypeError(f"{name} takes a string")
        return make(x), T.BooleanType()

    return checked


def like(e, pattern: str, case_sensitive: bool = True, opposite: bool = False) -> Expr:
    out = Function(lift(e), _text("like", lambda x: patterns.like(x, pattern, case_sensitive)))
    return Not(out) if opposite else out


def starts(e, prefix: str, case_sensitive: bool = True, opposite: bool = False) -> Expr:
    out = Function(lift(e), _text("starts", lambda x: patterns.starts(x, prefix, case_sensitive)))
    return Not(out) if opposite else out


def round_time(e, unit, tz_offset_minutes: int = 0, begin: int = 0) -> Expr:
    return Function(lift(e), lambda x, kind, _: (timefns.round_time(x, unit, tz_offset_minutes, begin), T.LongType()))


def script(name: str, kind: T.DataType, body, inputs: Sequence[str] = ()) -> Expr:
    return Script(name, kind, body, tuple(inputs))


def _aggregate(function: str, make) -> Callable:
    def build(e, *args, **more) -> Expr:
        return Aggregate(lift(e), function, lambda x, kind: make(x, kind, *args, **more))

    return build


count = _aggregate("count", lambda x, kind: aggregates.count())
sum_ = _aggregate("sum", aggregates.sum_)
min_ = _aggregate("min", aggregates.min_)
max_ = _aggregate("max", aggregates.max_)
avg = _aggregate("avg", aggregates.avg)
avg_exact = _aggregate("avg", aggregates.avg_exact)
pct = _aggregate("pct", aggregates.pct)
card = _aggregate("card", aggregates.card)
hist = _aggregate("hist", aggregates.hist)


def tpm(e, threshold: int = aggregates.TREE_THRESHOLD) -> Expr:
    return TreeMerge(lift(e), threshold)
