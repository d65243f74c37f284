"""The engine: a catalog and the ways to ask it."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .operators.access import QueryContext
from .plans import request as requests
from .plans import scripts
from .plans.query import Query


@dataclass(frozen=True)
class Answer:
    """Rows as JSON texts; milliseconds, and rows, files and bytes of the scans."""

    rows: list[str]
    ms: float
    rows_scanned: int
    blocks: int
    bytes: int


def _scans(node):
    """The leaves of an executed plan, those of adaptive stages included."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from _scans(node.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from _scans(node.plan())
    else:
        below = node.children()
        if not below.size():
            yield node
        for i in range(below.size()):
            yield from _scans(below.apply(i))


class Engine:
    """Entry point: ``engine.table(name)`` for fluent queries, ``engine.query(request)`` for service requests."""

    def __init__(self, spark: SparkSession, root: str | None = None, **more):
        self.spark = spark
        self.catalog = Catalog(spark, root, **more)

    def table(self, name: str, **options) -> Query:
        self.catalog.hit(name)
        return Query(self.catalog.table(name), **options)

    def query(self, request: requests.QueryRequest, context: QueryContext | None = None) -> DataFrame:
        return requests.run(request, self.catalog, context)

    def query_json(self, request: requests.QueryRequest, context: QueryContext | None = None):
        return requests.to_json(self.query(request, context))

    def answer(self, request: requests.QueryRequest, context: QueryContext | None = None) -> Answer:
        """Run a service request; its rows, which the request's limit bounds, with what it took."""
        began = time.perf_counter()
        out = self.query(request, context)
        texts = out.select(F.to_json(F.struct(*requests.texts(out))))
        rows = [r[0] for r in texts.collect()]
        scans = list(_scans(texts._jdf.queryExecution().executedPlan()))
        total = lambda metric: sum(m.get().value() for m in (s.metrics().get(metric) for s in scans) if m.isDefined())
        return Answer(rows, 1000 * (time.perf_counter() - began), total("numOutputRows"), total("numFiles"), total("filesSize"))

    def register_function(self, name: str, function: Callable, kind) -> None:
        """A Python function of pandas series, for use in SQL expressions of computed columns."""
        self.spark.udf.register(name, F.pandas_udf(function, kind))
        scripts.register(name)
