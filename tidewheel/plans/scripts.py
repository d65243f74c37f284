"""What computed columns may do, checked on the parsed expression and on the analysed plan, before anything runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

#: Groups of built-in functions that an expression may call: scalar ones that see nothing but their arguments.
GROUPS = frozenset(f"{g}_funcs" for g in ("array", "bitwise", "collection", "conditional", "conversion", "datetime", "hash", "json", "lambda", "map", "math", "predicate", "string", "struct", "url", "variant"))
#: Nodes of the parser's own package that an expression may have; others stand for stars, identifiers made at run time and the like.
UNRESOLVED = frozenset({"UnresolvedAttribute", "UnresolvedFunction", "UnresolvedExtractValue"})
_EXPRESSIONS, _ANALYSIS = "org.apache.spark.sql.catalyst.expressions.", "org.apache.spark.sql.catalyst.analysis."

#: Functions that the engine's owner has registered.
own_functions: set[str] = set()


def _each(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _allowed(spark: SparkSession, name: str) -> bool:
    if name in own_functions:
        return True
    catalog, jvm = spark._jsparkSession.sessionState().catalog(), spark._jvm
    identifier = jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
    if not catalog.isBuiltinFunction(identifier) or catalog.isTemporaryFunction(identifier):
        return False
    return catalog.lookupFunctionInfo(identifier).getGroup() in GROUPS


def check_sql(spark: SparkSession, sql: str) -> None:
    """Refuse what isn't a scalar expression of columns: stars, subqueries, windows, aggregates, unknown functions, and built-in ones outside
    GROUPS, such as those that call into the JVM or ask about the session."""
    plan = spark._jvm.java.lang.Class.forName(f"{_EXPRESSIONS}PlanExpression")
    todo = [spark._jsparkSession.sessionState().sqlParser().parseExpression(sql)]
    while todo:
        node = todo.pop()
        name = node.getClass().getName()
        short = name.rpartition(".")[2]
        known = short in UNRESOLVED if name.startswith(_ANALYSIS) else name.startswith(_EXPRESSIONS)
        if not known or plan.isInstance(node) or short.startswith("Window"):
            raise ValueError(f"a computed column can't have {short}")
        if short == "UnresolvedFunction":
            parts = list(_each(node.nameParts()))
            if len(parts) > 1 or not _allowed(spark, parts[0].lower()):
                raise ValueError(f"a computed column can't call {'.'.join(parts)}")
        todo += _each(node.children())


def columns_of(df: DataFrame, column: Column) -> set[str]:
    """The columns of ``df`` that an expression refers to, as the analyser resolves them, whatever their spelling."""
    made = df.select(column)._jdf.queryExecution().analyzed().expressions()
    return {a.name() for e in _each(made) for a in _each(e.references())}


def register(name: str) -> None:
    own_functions.add(name.lower())

