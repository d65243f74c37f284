"""From a fluent query to a DataFrame.

A query is: a table, a filter, computed columns, selected fields, group keys, one sort key, a limit. Building it checks types and
access and gives one declarative plan; Catalyst does the rest.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AuthRequired, EngineError, FailCompileQuery, MissingOutputFields, PermissionRequired
from ..operators import aggregates
from ..operators.access import Access, Action, QueryContext, check, masked
from ..schema import zero
from ..sources.convert import unique
from .expressions import Col, Compare, Expr, In, Literal, Logical, Not, Scope, Script, Star, TreeMerge, lift
from .scripts import columns_of

if TYPE_CHECKING:
    from ..catalog import Table


#: Values of a list that may be broadcast; they come with the request.
BROADCAST_LIST = 1 << 20


@dataclass(frozen=True)
class Query:
    """Each method returns a new query; ``build`` gives the frame."""

    table: Table
    filter: Expr | None = None
    scripts: tuple[Script, ...] = ()
    fields: tuple[Expr, ...] = ()
    keys: tuple[int, ...] | None = None
    sorts: tuple[int, ...] = ()
    descending: bool = False
    top: int = 0
    range: tuple[int, int] | None = None
    null_as_default: bool = False
    drop_empty_global: bool = False
    options: dict = field(default_factory=dict)

    def where(self, condition: Expr) -> Query:
        return replace(self, filter=condition if self.filter is None else Logical("and", self.filter, condition))

    def between_times(self, start: int, end: int) -> Query:
        """Rows of the inclusive range of epoch seconds; tables laid out by date read only its days."""
        return replace(self, range=(int(start), int(end)))

    def apply(self, name: str, kind: T.DataType, body, inputs: Sequence[str] = ()) -> Query:
        """Add a computed column: an SQL expression, or a Python function of pandas series over ``inputs``."""
        return replace(self, scripts=(*self.scripts, Script(name, kind, body, tuple(inputs))))

    def select(self, *fields) -> Query:
        return replace(self, fields=tuple(f if isinstance(f, Expr) else lift(f) for f in fields))

    def groupby(self, *positions: int) -> Query:
        """Keys as 1-based positions among the fields; they must be all those that aren't aggregates."""
        return replace(self, keys=tuple(positions))

    def sortby(self, position: int, descending: bool = False) -> Query:
        return replace(self, sorts=(position,), descending=descending)

    def limit(self, n: int) -> Query:
        return replace(self, top=n)

    def build(self, context: QueryContext | None = None) -> DataFrame:
        try:
            return _build(self, context or QueryContext())
        except EngineError:
            raise
        except (TypeError, ValueError, KeyError, AnalysisException) as e:
            raise FailCompileQuery(str(e)) from e


class _Guard:
    """Access to columns. Computed columns count as the table's columns that they come from, as the analyser resolves them."""

    def __init__(self, query: Query, context: QueryContext):
        self.rules, self.groups = query.table.column_rules, context.groups
        self.origin: dict[str, set[str]] = {}

    def sources(self, names: set[str]) -> set[str]:
        return names.union(*(self.origin.get(n.lower(), ()) for n in names))

    def add(self, df: DataFrame, s: Script) -> DataFrame:
        """``df`` with a computed column."""
        column = s.column(Scope(df))[0]
        self.origin[s.name.lower()] = self.sources(columns_of(df, column))
        return df.withColumn(s.name, column)

    def action(self, df: DataFrame, e: Expr, access: Access) -> Action:
        """The strongest action on what an expression refers to."""
        names = e.references().union(*(columns_of(df, s.column(Scope(df))[0]) for s in e.scripts()))
        return max((check(access, self.groups, self.rules(n)) for n in self.sources(names)), default=Action.PASS)


def _build(query: Query, context: QueryContext) -> DataFrame:
    table = query.table
    if context.auth_required and not context.groups:
        raise AuthRequired()
    if not query.fields:
        raise MissingOutputFields()
    if check(Access.READ, context.groups, table.rules) != Action.PASS:
        raise PermissionRequired(f"table {table.name}")
    made = {s.name.lower() for s in query.scripts}  # these may replace a column
    df = table.rows(query.range, {n: x for n, x in _equals(query.filter).items() if n.lower() not in made})
    guard = _Guard(query, context)
    for s in query.scripts:
        df = guard.add(df, s)
    names = set(df.columns)
    fields: list[Expr] = []
    for f in query.fields:
        fields += [Col(c) for c in table.columns()] if isinstance(f, Star) else [f]

    # access: columns that only select may be masked; everything else that touches them is refused
    visible: list[tuple[Expr, bool]] = []
    grouped = any(f.is_aggregate for f in fields)
    if grouped and check(Access.AGGREGATION, context.groups, table.rules) != Action.PASS:
        raise PermissionRequired(f"aggregation of table {table.name}")
    for f in fields:
        if missing := f.references() - names:
            raise FailCompileQuery(f"no column {sorted(missing)[0]!r}")
        action = guard.action(df, f, Access.READ)
        if f.is_aggregate:
            if max(action, guard.action(df, f, Access.AGGREGATION)) != Action.PASS:
                raise PermissionRequired(f"aggregation of {f.name}")
        elif action == Action.DENY:
            raise PermissionRequired(f"column {f.name}")
        visible.append((f, action == Action.MASK))
    if query.filter is not None:
        if query.filter.is_aggregate:
            raise FailCompileQuery("a filter has no aggregates")
        if guard.action(df, query.filter, Access.READ) != Action.PASS:
            raise PermissionRequired("a filter on a protected column")

    scope = Scope(df, query.null_as_default)
    if query.filter is not None:
        df = _filtered(df, query.filter, scope)
    named = unique([f.name or f"field_{i + 1}" for i, (f, _) in enumerate(visible)])
    if len(query.sorts) > 1:
        raise FailCompileQuery("one sort key at most")
    if any(not 1 <= s <= len(fields) for s in query.sorts):
        raise FailCompileQuery("the sort key is no selected field")
    plain = [i for i, f in enumerate(fields) if not f.is_aggregate]
    if query.keys is not None:
        if grouped and sorted(k - 1 for k in query.keys) != plain:
            raise FailCompileQuery("the group keys must be all fields that aren't aggregates")
    out = _aggregated(df, visible, named, scope, query) if grouped or query.keys else _projected(df, visible, named, scope)
    if query.sorts:
        first = named[query.sorts[0] - 1]
        by = F.col(f"`{first}`")
        # the other scalar columns break ties, so that a limit gives the same rows again
        rest = [F.col(f"`{c.name}`") for c in out.schema if c.name != first and not isinstance(c.dataType, T.MapType)]
        out = out.orderBy(by.desc() if query.descending else by.asc(), *rest)
    return out.limit(query.top) if query.top else out


def _equals(condition: Expr | None) -> dict[str, list]:
    """Columns that a filter limits to some values, by its conjuncts."""
    if isinstance(condition, Logical) and condition.op == "and":
        left, right = _equals(condition.left), _equals(condition.right)
        return {**left, **right}
    if isinstance(condition, In) and not condition.negated and isinstance(condition.inner, Col):
        return {condition.inner.source: condition.values}
    if isinstance(condition, Compare) and condition.op == "==":
        for a, b in ((condition.left, condition.right), (condition.right, condition.left)):
            if isinstance(a, Col) and isinstance(b, Literal):
                return {a.source: [b.value]}
    return {}


def _filtered(df: DataFrame, condition: Expr, scope: Scope) -> DataFrame:
    """Long lists become semi and anti joins, where they are conjuncts; the rest is one predicate."""
    if isinstance(condition, Logical) and condition.op == "and":
        return _filtered(_filtered(df, condition.left, scope), condition.right, Scope(df, scope.null_as_default))
    if isinstance(condition, Not) and isinstance(condition.inner, In) and condition.inner.is_long:
        condition = In(condition.inner.inner, condition.inner.values, not condition.inner.negated)
    if isinstance(condition, In) and condition.is_long:
        x, kind = condition.inner.column(scope)
        found = sorted(set(condition.values))
        values = df.sparkSession.createDataFrame([(v,) for v in found], T.StructType([T.StructField("__value", kind)]))
        if len(found) <= BROADCAST_LIST:  # the table stays where it is
            values = F.broadcast(values)
        # the list's range reaches the files, which a join's keys don't
        rows = df.where(x.isNotNull() if condition.negated else x.between(F.lit(found[0]).cast(kind), F.lit(found[-1]).cast(kind)))
        return rows.join(values, x == F.col("__value"), "left_anti" if condition.negated else "left_semi")
    column, kind = condition.column(scope)
    if not isinstance(kind, T.BooleanType):
        raise TypeError("a filter is a boolean")
    return df.where(column)


def _select(f: Expr, hide: bool, name: str, scope: Scope):
    x, kind = f.column(scope)
    if hide:
        x = masked(kind)
    elif scope.null_as_default and (fill := zero(kind)) is not None:
        x = F.coalesce(x, F.lit(fill).cast(kind))
    return x.alias(name)


def _projected(df: DataFrame, visible, named: list[str], scope: Scope) -> DataFrame:
    return df.select(*(_select(f, hide, n, scope) for (f, hide), n in zip(visible, named, strict=True)))


def _aggregated(df: DataFrame, visible, named: list[str], scope: Scope, query: Query) -> DataFrame:
    keys, plain, trees = [], [], []
    for (f, hide), n in zip(visible, named, strict=True):
        if not f.is_aggregate:
            keys.append(_select(f, hide, n, scope))
        elif isinstance(f, TreeMerge):
            trees.append((f, n))
        else:
            plain.append(f.column(scope)[0].alias(n))
    key_names = [n for (f, _), n in zip(visible, named, strict=True) if not f.is_aggregate]
    grouped = df.groupBy(*keys)
    out = None
    if plain or not trees:
        out = grouped.agg(*plain) if plain else df.select(*keys).distinct()
        if not keys and query.drop_empty_global:
            out = df.agg(F.count(F.lit(1)).alias("__rows"), *plain).where("__rows > 0").drop("__rows")
    for f, n in trees:
        x, kind = f.inner.column(scope)
        if not isinstance(kind, T.StringType):
            raise TypeError("tpm takes a string")
        tree = aggregates.tree_merge(df.select(*keys, x.alias("__stack")), key_names, "__stack", n, f.threshold)
        if out is None:
            out = tree
        elif key_names:
            renamed = tree.select(*(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(key_names)), f"`{n}`")
            same = F.lit(True)
            for i, k in enumerate(key_names):
                same = same & out[f"`{k}`"].eqNullSafe(renamed[f"__k{i}"])
            out = out.join(renamed, same).drop(*(f"__k{i}" for i in range(len(key_names))))
        else:
            out = out.join(F.broadcast(tree))  # one row each
    return out.select(*(F.col(f"`{n}`") for n in named))


