"""Registered queries and their oracle SQL.

Most go through the engine, as a fluent query or a service request, over whole tables; agg_tree_merge and hash_bucket call the functions
below it, whose results the engine's JSON and layouts are made of. Those of ``stored`` put the tables elsewhere first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..engine import Engine
from ..functions.codecs import delta_encode, hash_bucket
from ..functions.timefns import wall_seconds
from ..operators.access import Access, Action, QueryContext, Rule
from ..operators.aggregates import tree_counts
from ..operators.transforms import map_columns, pivot, remove, unpack_histogram
from ..plans.expressions import avg, avg_exact, between, card, col, count, hist, in_, like, max_, min_, nin, pct, reverse, round_time, script, starts, sum_, tpm, v
from ..plans.query import Query
from ..plans.request import ALL_ROWS, All, Any, Custom, Metric, Order, Predicate, QueryRequest
from ..spec import ColumnProps, TimeSpec
from . import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Time columns of the tables; tables without one are static.
TIMES = {"events": "ts", "lineitem": "l_shipdate", "orders": "o_orderdate"}
#: The ranges that requests ask: January 2024 and 1990 to 2009, which hold the whole tables.
START, END = 1704067200, 1706745600
L_START, L_END = 631152000, 1262303999
#: The range that the time filter's query cuts out: 2024-01-05 to 2024-01-25.
FROM, TO = 1704412800, 1706140800

EVENTS = "(SELECT *, epoch_us(ts) // 1000000 AS _time_ FROM events)"
LINEITEM = "(SELECT *, epoch_us(l_shipdate) // 1000000 AS _time_ FROM lineitem)"
ORDERS = "(SELECT *, epoch_us(o_orderdate) // 1000000 AS _time_ FROM orders)"


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn("_time_", wall_seconds(F.col(TIMES[name])) if name in TIMES else F.lit(0).cast("long"))


def engine(spark: SparkSession, sf_dir: str, *names: str, **more) -> Engine:
    out = Engine(spark)
    for n in names:
        out.catalog.register(n, source(spark, sf_dir, n), time_from=TIMES.get(n), **more)
    return out


def register(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def fluent(name: str, table: str, make: Callable[[Query], Query], oracle: str) -> None:
    register(name, oracle)(lambda spark, d: make(engine(spark, d, table).table(table)).build())


def service(name: str, request: QueryRequest, oracle: str, rename: dict[str, str] | None = None) -> None:
    def run(spark, d):
        out = engine(spark, d, request.table).query(request)
        return out.withColumnsRenamed(rename) if rename else out

    register(name, oracle)(run)


# filters

def _filters() -> None:
    flag = "value > 50"
    cases = {
        "filter_eq": (col("event_type") == v("click"), "event_type = 'click'"),
        "filter_neq": (col("event_type") != v("click"), "event_type <> 'click'"),
        "filter_gt_lt": ((col("value") > 20.0) & (col("value") < 60.0), "value > 20 AND value < 60"),
        "filter_ge_le": ((col("user_id") >= 10) & (col("user_id") <= 40), "user_id >= 10 AND user_id <= 40"),
        "filter_and": ((col("event_type") == v("view")) & (col("value") > 50.0), "event_type = 'view' AND value > 50"),
        "filter_or": ((col("event_type") == v("view")) | (col("value") > 90.0), "event_type = 'view' OR value > 90"),
        "filter_not": (reverse(col("value") > 50.0), f"NOT ({flag})"),
        "filter_in": (in_(col("event_type"), ["click", "error"]), "event_type IN ('click', 'error')"),
        "filter_not_in": (nin(col("event_type"), ["click", "error"]), "event_type NOT IN ('click', 'error')"),
        "filter_between": (between(col("value"), 25, 75), "value BETWEEN 25 AND 75"),
        "filter_like": (like(col("event_type"), "%i%"), "event_type LIKE '%i%'"),
        "filter_ilike": (like(col("event_type"), "%I%", case_sensitive=False), "lower(event_type) LIKE '%i%'"),
        "filter_unlike": (like(col("event_type"), "%i%", opposite=True), "event_type NOT LIKE '%i%'"),
        "filter_iunlike": (like(col("event_type"), "%I%", case_sensitive=False, opposite=True), "lower(event_type) NOT LIKE '%i%'"),
    }
    for name, (condition, sql) in cases.items():
        fluent(name, "events", lambda q, c=condition: q.where(c).select(col("event_id"), col("event_type"), col("user_id"), col("value")), f"SELECT event_id, event_type, user_id, value FROM events WHERE {sql}")
    fluent("filter_prefix", "part", lambda q: q.where(starts(col("p_brand"), "Brand#1")).select(col("p_partkey"), col("p_brand")), "SELECT p_partkey, p_brand FROM part WHERE starts_with(p_brand, 'Brand#1')")
    fluent("filter_iprefix", "part", lambda q: q.where(starts(col("p_brand"), "bRAND#2", case_sensitive=False)).select(col("p_partkey"), col("p_brand")), "SELECT p_partkey, p_brand FROM part WHERE starts_with(lower(p_brand), 'brand#2')")
    fluent(
        "filter_like_literal_underscore", "events",
        lambda q: q.apply("tagged", T.StringType(), "concat(event_type, if(user_id % 2 = 0, '_', 'x'), user_id)").where(like(col("tagged"), "%k_1%")).select(col("event_id"), col("tagged")),
        "SELECT event_id, tagged FROM (SELECT event_id, concat(event_type, CASE WHEN user_id % 2 = 0 THEN '_' ELSE 'x' END, user_id) AS tagged FROM events) WHERE contains(tagged, 'k_1')",
    )
    fluent("filter_time_range", "events", lambda q: q.between_times(FROM, TO).select(col("event_id"), col("_time_")), f"SELECT event_id, _time_ FROM {EVENTS} WHERE _time_ BETWEEN {FROM} AND {TO}")
    fluent("filter_null_rejects", "events", lambda q: q.apply("known", T.StringType(), "nullif(event_type, 'error')").where(nin(col("known"), ["click"])).select(col("event_id"), col("known")), "SELECT event_id, known FROM (SELECT event_id, nullif(event_type, 'error') AS known FROM events) WHERE known NOT IN ('click')")
    fluent("filter_in_long_list", "lineitem", lambda q: q.where(in_(col("l_orderkey"), range(0, 20000, 3))).select(col("l_orderkey"), col("l_linenumber")), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT unnest(range(0, 20000, 3)))")
    fluent("filter_not_in_long_list", "lineitem", lambda q: q.where(nin(col("l_orderkey"), range(0, 20000, 3))).select(col("l_orderkey"), col("l_linenumber")), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT unnest(range(0, 20000, 3)))")
    fluent("filter_in_zip", "events", lambda q: q.where(in_(col("user_id"), delta_encode([3, 77, 5, 5]))).select(col("event_id"), col("user_id")), "SELECT event_id, user_id FROM events WHERE user_id IN (3, 5, 77)")
    fluent("filter_boolean_column", "events", lambda q: q.apply("flag", T.BooleanType(), "value > 50").where(col("flag") == v(True)).select(col("event_id"), col("flag")), "SELECT event_id, true AS flag FROM events WHERE value > 50")
    service(
        "filter_service_or", QueryRequest("events", START, END, Any([Predicate("event_type", "EQ", ["click", "view"]), Predicate("value", "MORE", [95])]), ["event_type"], [Metric("event_id", "COUNT")]),
        f"SELECT event_type, count(*) AS n FROM {EVENTS} WHERE _time_ BETWEEN {START} AND {END} AND (event_type IN ('click', 'view') OR value > 95) GROUP BY 1", {"event_id.COUNT": "n"},
    )
    service(
        "filter_service_nested", QueryRequest("events", START, END, All([Predicate("event_type", "NEQ", ["error", "view"]), Any([Predicate("value", "LESS", [10]), Predicate("event_type", "ILIKE", ["PUR%"])])]), ["event_type"], [Metric("event_id", "COUNT")]),
        f"SELECT event_type, count(*) AS n FROM {EVENTS} WHERE _time_ BETWEEN {START} AND {END} AND event_type NOT IN ('error', 'view') AND (value < 10 OR event_type ILIKE 'pur%') GROUP BY 1", {"event_id.COUNT": "n"},
    )


# projection

def _projection() -> None:
    fluent("select_star", "supplier", lambda q: q.select(col("*")), "SELECT *, CAST(0 AS BIGINT) AS _time_ FROM supplier")
    fluent(
        "select_arith", "lineitem", lambda q: q.select(col("l_orderkey"), col("l_linenumber"), (col("l_extendedprice") * (v(1.0) - col("l_discount"))).as_("net"), (col("l_linenumber") * 3 + 1).as_("tripled"), (col("l_quantity") - col("l_linenumber")).as_("less")),
        "SELECT l_orderkey, l_linenumber, l_extendedprice * (1.0::DOUBLE - l_discount) AS net, CAST(l_linenumber * 3 + 1 AS INTEGER) AS tripled, l_quantity - l_linenumber AS less FROM lineitem",
    )
    fluent("select_int_div", "part", lambda q: q.select(col("p_partkey"), (col("p_size") / 7).as_("sevenths"), ((v(0) - col("p_size")) / 2).as_("half")), "SELECT p_partkey, p_size // 7 AS sevenths, CAST(trunc((0 - p_size) / 2) AS INTEGER) AS half FROM part")
    fluent("select_mod", "part", lambda q: q.select(col("p_partkey"), (col("p_size") % 7).as_("rest"), (col("p_size") % (col("p_size") - col("p_size"))).as_("nothing")), "SELECT p_partkey, p_size % 7 AS rest, CAST(NULL AS INTEGER) AS nothing FROM part")
    fluent("select_wraparound", "lineitem", lambda q: q.select(col("l_orderkey"), col("l_linenumber"), (col("l_linenumber") * 2147483647).as_("wrapped")), "SELECT l_orderkey, l_linenumber, CAST((CAST(l_linenumber AS HUGEINT) * 2147483647 + 2147483648) % 4294967296 - 2147483648 AS INTEGER) AS wrapped FROM lineitem")
    fluent("custom_column", "events", lambda q: q.apply("tens", T.LongType(), "user_id div 10").where(col("tens") > 3).select(col("event_id"), col("tens")), "SELECT event_id, user_id // 10 AS tens FROM events WHERE user_id // 10 > 3")
    fluent("custom_column_in_agg", "events", lambda q: q.apply("tens", T.LongType(), '() => t.column("user_id") % 10').select(col("tens"), count(v(1)).as_("n"), sum_(col("tens")).as_("total")).groupby(1), "SELECT user_id % 10 AS tens, count(*) AS n, CAST(sum(user_id % 10) AS BIGINT) AS total FROM events GROUP BY 1")
    fluent("custom_column_python", "events", lambda q: q.apply("double", T.DoubleType(), lambda x: x * 2.0, ["value"]).select(col("event_id"), col("double")), "SELECT event_id, value * 2 AS double FROM events")
    fluent("script_field", "events", lambda q: q.select(col("event_id"), script("kind", T.StringType(), "upper(event_type)")), "SELECT event_id, upper(event_type) AS kind FROM events")

    rules = {"c_name": ColumnProps(rules=(Rule(Access.READ, frozenset({"pii"}), Action.MASK),)), "c_acctbal": ColumnProps(rules=(Rule(Access.READ, frozenset({"pii"}), Action.MASK),))}

    def masked(spark, d, groups=("eng",)):
        e = engine(spark, d, "customer", columns=rules)
        return e.table("customer").select(col("c_custkey"), col("c_name"), col("c_acctbal"), col("c_mktsegment")).build(QueryContext.of("someone", groups))

    register("mask_column", "SELECT c_custkey, '***' AS c_name, 0.0::DOUBLE AS c_acctbal, c_mktsegment FROM customer")(masked)
    register("mask_column_member", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")(lambda spark, d: masked(spark, d, ("pii", "eng")))
    register("mask_script", "SELECT c_custkey, '***' AS shown, c_mktsegment FROM customer")(
        lambda spark, d: engine(spark, d, "customer", columns=rules).table("customer").apply("shown", T.StringType(), "upper(C_NAME)").select(col("c_custkey"), col("shown"), col("c_mktsegment")).build(QueryContext.of("someone", ["eng"]))
    )
    fluent(
        "null_as_default", "events", lambda q: Query(q.table, null_as_default=True).apply("known", T.DoubleType(), "if(value > 100, null, value)").select(col("event_type"), min_(col("known")).as_("least"), count(col("known")).as_("n")),
        "SELECT event_type, min(coalesce(CASE WHEN value > 100 THEN NULL ELSE value END, 0)) AS least, count(*) AS n FROM events GROUP BY 1",
    )

    def defaults(spark, d):
        e = Engine(spark)
        df = source(spark, d, "events").withColumn("event_type", F.expr("nullif(event_type, 'error')"))
        e.catalog.register("events", df, columns={"event_type": ColumnProps(default_value="unknown")})
        return e.table("events").select(col("event_type"), count(v(1)).as_("n")).build()

    register("column_default", "SELECT CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS event_type, count(*) AS n FROM events GROUP BY 1")(defaults)


# aggregation

HIST_EDGES = [i * 10.0 for i in range(11)]


def _hist_sql(value: str, edges: list, whole: bool) -> str:
    """The histogram's rows: label and count."""
    show = lambda x: str(x) if x is not None else ""
    inside = [(None, edges[0]), *zip(edges, edges[1:], strict=False), (edges[-1], None)]
    return " UNION ALL ".join(
        f"SELECT k, '[{show(a)},{show(b)})' AS label, CAST(count(*) FILTER (WHERE {' AND '.join([f'{value} >= {a}'] * (a is not None) + [f'{value} < {b}'] * (b is not None))}) AS BIGINT) AS count FROM t GROUP BY k"
        for a, b in inside
    )


def _aggregation() -> None:
    key = col("event_type")
    simple = {
        "agg_count": ([count(v(1)).as_("n"), count(col("value")).as_("m")], "count(*) AS n, count(*) AS m"),
        "agg_sum": ([sum_(col("value")).as_("total"), sum_(col("user_id")).as_("users")], "sum(value) AS total, CAST(sum(user_id) AS BIGINT) AS users"),
        "agg_min": ([min_(col("value")).as_("least"), min_(col("user_id")).as_("first_user")], "min(value) AS least, min(user_id) AS first_user"),
        "agg_max": ([max_(col("value")).as_("most"), max_(col("user_id")).as_("last_user")], "max(value) AS most, max(user_id) AS last_user"),
        "agg_avg": ([avg(col("value")).as_("mean"), avg_exact(col("user_id")).as_("user_mean")], "avg(value) AS mean, avg(user_id) AS user_mean"),
        "agg_avg_int_trunc": ([avg(col("user_id")).as_("mean")], "CAST(sum(user_id) // count(user_id) AS BIGINT) AS mean"),
        "agg_pct_exact": ([pct(col("value"), 50, exact=True).as_("p50"), pct(col("value"), 99, exact=True).as_("p99"), pct(col("user_id"), 90, exact=True).as_("u90")], "quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99, CAST(floor(quantile_cont(CAST(user_id AS DOUBLE), 0.9)) AS BIGINT) AS u90"),
        "agg_card_exact": ([card(col("user_id"), exact=True).as_("users")], "count(DISTINCT user_id) AS users"),
    }
    for name, (fields, sql) in simple.items():
        fluent(name, "events", lambda q, f=fields: q.select(key, *f).groupby(1), f"SELECT event_type, {sql} FROM events GROUP BY 1")
    fluent("agg_global", "lineitem", lambda q: q.select(count(v(1)).as_("n"), sum_(col("l_quantity")).as_("quantity"), avg(col("l_discount")).as_("discount")), "SELECT count(*) AS n, sum(l_quantity) AS quantity, avg(l_discount) AS discount FROM lineitem")
    fluent("agg_global_empty", "lineitem", lambda q: Query(q.table, drop_empty_global=True).where(col("l_quantity") > 1e9).select(count(v(1)).as_("n"), sum_(col("l_quantity")).as_("quantity")), "SELECT count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_quantity > 1e9 HAVING count(*) > 0")
    fluent("agg_multi_key", "lineitem", lambda q: q.select(col("l_returnflag"), col("l_linestatus"), sum_(col("l_quantity")).as_("quantity"), sum_(col("l_extendedprice") * (v(1.0) - col("l_discount"))).as_("revenue"), count(v(1)).as_("n")).groupby(1, 2), "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, sum(l_extendedprice * (1.0::DOUBLE - l_discount)) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2")
    fluent("agg_expression_key", "part", lambda q: q.select((col("p_size") / 10).as_("tens"), avg(col("p_size")).as_("size"), max_(col("p_retailprice")).as_("price")), "SELECT p_size // 10 AS tens, CAST(sum(p_size) // count(*) AS INTEGER) AS size, max(p_retailprice) AS price FROM part GROUP BY 1")

    def int128(spark, d):
        q = engine(spark, d, "lineitem").table("lineitem").apply("big", T.DecimalType(38, 0), "cast(l_orderkey as decimal(38,0))")
        out = q.select(col("l_returnflag"), sum_(col("big")).as_("total"), max_(col("big")).as_("most")).build()
        return out.select("l_returnflag", F.col("total").cast("string"), F.col("most").cast("string"))

    register("agg_int128", "SELECT l_returnflag, CAST(CAST(sum(l_orderkey) AS BIGINT) AS VARCHAR) AS total, CAST(max(l_orderkey) AS VARCHAR) AS most FROM lineitem GROUP BY 1")(int128)

    def histogram(spark, d):
        out = engine(spark, d, "events").table("events").select(col("event_type"), hist(col("value"), 0, 100).as_("h")).groupby(1).build()
        return unpack_histogram(out.withColumnRenamed("event_type", "k"), "h")

    register("agg_hist", f"WITH t AS (SELECT event_type AS k, value FROM events) {_hist_sql('value', HIST_EDGES, False)}")(histogram)

    def histogram_int(spark, d):
        out = engine(spark, d, "lineitem").table("lineitem").select(col("l_returnflag"), hist(col("l_linenumber"), 1, 7).as_("h")).groupby(1).build()
        return unpack_histogram(out.withColumnRenamed("l_returnflag", "k"), "h")

    register("agg_hist_int", f"WITH t AS (SELECT l_returnflag AS k, l_linenumber AS value FROM lineitem) {_hist_sql('value', list(range(1, 12)), True)}")(histogram_int)

    stack = "concat(event_type, '\n', user_id % 10)"

    def trees(spark, d):
        df = source(spark, d, "events").withColumn("stack", F.expr(stack)).withColumn("parity", F.col("event_id") % 2)
        return tree_counts(df, ["parity"], "stack").select("parity", F.array_join("path", "/").alias("path"), "n")

    register("agg_tree_merge", "WITH t AS (SELECT event_id % 2 AS parity, event_type AS a, user_id % 10 AS b FROM events) SELECT parity, '' AS path, count(*) AS n FROM t GROUP BY 1 UNION ALL SELECT parity, a, count(*) FROM t GROUP BY 1, 2 UNION ALL SELECT parity, concat(a, '/', b), count(*) FROM t GROUP BY 1, a, b")(trees)
    node = lambda name, n, below: f"""concat('{{"name":"', {name}, '","value":', {n}, {below}, '}}')"""
    kinds = node("event_type", "n", "below")
    tree_sql = f"""
        WITH t AS (SELECT event_type, CAST(user_id % 10 AS VARCHAR) AS digit, count(*) AS n FROM events GROUP BY ALL),
        kinds AS (SELECT event_type, CAST(sum(n) AS BIGINT) AS n, coalesce(',"children":[' || string_agg({node("digit", "n", "''")}, ',' ORDER BY digit) FILTER (WHERE n >= 3) || ']', '') AS below FROM t GROUP BY 1)
        SELECT event_type, CASE WHEN n < 3 THEN '' ELSE {node("''", "n", f"""',"children":[', {kinds}, ']'""")} END AS tree, n FROM kinds"""
    register("agg_tree_merge_json", tree_sql)(lambda spark, d: engine(spark, d, "events").table("events").apply("stack", T.StringType(), stack).select(col("event_type"), tpm(col("stack"), 3).as_("tree"), count(v(1)).as_("n")).groupby(1).build())
    register("agg_pct_approx")(lambda spark, d: engine(spark, d, "events").table("events").select(col("event_type"), pct(col("value"), 50).as_("p50"), pct(col("value"), 99).as_("p99")).groupby(1).build())
    register("agg_card_est")(lambda spark, d: engine(spark, d, "lineitem").table("lineitem").select(col("l_returnflag"), card(col("l_orderkey")).as_("orders")).groupby(1).build())

    # estimates against the exact values: the rank is within the promised error, the count within three standard errors
    def pct_bound(spark, d):
        q = engine(spark, d, "events").table("events")
        est = q.select(col("event_type"), pct(col("value"), 50).as_("p50"), pct(col("value"), 99).as_("p99"), count(v(1)).as_("n")).groupby(1).build()
        ranks = source(spark, d, "events").join(F.broadcast(est), "event_type").groupBy("event_type").agg(*(F.abs(F.count_if(F.col("value") <= F.col(p)) - F.first("n") * x).alias(p) for p, x in (("p50", 0.5), ("p99", 0.99))), F.first("n").alias("n"))
        return ranks.select("event_type", *((F.col(p) <= 1 + F.col("n") * 1e-4).alias(p) for p in ("p50", "p99")))

    register("agg_pct_approx_bound", "SELECT event_type, true AS p50, true AS p99 FROM events GROUP BY 1")(pct_bound)
    register("agg_card_est_bound", "SELECT l_returnflag, true AS near FROM lineitem GROUP BY 1")(
        lambda spark, d: engine(spark, d, "lineitem").table("lineitem").select(col("l_returnflag"), card(col("l_orderkey")).as_("est"), card(col("l_orderkey"), exact=True).as_("exact")).groupby(1).build().select("l_returnflag", (F.abs(F.col("est") - F.col("exact")) <= 1 + F.col("exact") * 3 * 0.0041).alias("near"))
    )


# timelines

def _timelines() -> None:
    def timeline(name, table, start, end, sql_window, sql_table, value, **more):
        service(
            name, QueryRequest(table, start, end, dimensions=more.pop("dimensions", ()), metrics=[Metric(value, "COUNT"), Metric(value, "SUM")], timeline=True, **more),
            f"SELECT {sql_window} AS _window_, {'event_type, ' if name == 'timeline_by_dimension' else ''}count(*) AS n, sum({value}) AS total FROM {sql_table} WHERE _time_ BETWEEN {start} AND {end} GROUP BY ALL",
            {f"{value}.COUNT": "n", f"{value}.SUM": "total"},
        )

    span = END - START
    timeline("timeline_auto", "events", START, END, f"(_time_ - {START}) // {span // 100} * {span // 100}", EVENTS, "value")
    timeline("timeline_fixed", "events", START, END, f"(_time_ - {START}) // 43200 * 43200", EVENTS, "value", window=43200)
    timeline("timeline_single_bucket", "events", START, END, "CAST(0 AS BIGINT)", EVENTS, "value", window=span)
    trunc = lambda unit, t="_time_": f"greatest(0, CAST(epoch(date_trunc('{unit}', make_timestamp({t} * 1000000))) AS BIGINT) - {{s}})"
    timeline("timeline_hour", "events", START, END, trunc("hour").format(s=START), EVENTS, "value", time_unit=1)
    timeline("timeline_day", "events", START, END, trunc("day").format(s=START), EVENTS, "value", time_unit=2)
    week = f"greatest(0, CAST(epoch(date_trunc('day', make_timestamp(_time_ * 1000000))) AS BIGINT) - 86400 * dayofweek(make_timestamp(_time_ * 1000000)) - {START})"
    timeline("timeline_week_sunday", "events", START, END, week, EVENTS, "value", time_unit=3)
    for k, unit in ((4, "month"), (5, "quarter"), (6, "year")):
        timeline(f"timeline_{unit}", "orders", L_START, L_END, trunc(unit).format(s=L_START), ORDERS, "o_totalprice", time_unit=k)
    timeline("timeline_tz_offset", "events", START, END, trunc("day", f"(_time_ - {300 * 60})").format(s=START), EVENTS, "value", time_unit=2, tz_offset=300)
    timeline("timeline_by_dimension", "events", START, END, f"(_time_ - {START}) // 86400 * 86400", EVENTS, "value", window=86400, dimensions=["event_type"])
    fluent("round_time_column", "orders", lambda q: q.select(col("o_orderkey"), round_time(col("_time_"), "week").as_("week")), "SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) - 86400 * dayofweek(o_orderdate) AS week FROM orders")


# sorting, top-k, transforms, metadata

def _rest() -> None:
    fluent("sort_asc", "nation", lambda q: q.select(col("n_name"), col("n_nationkey")).sortby(1), "SELECT n_name, n_nationkey FROM nation ORDER BY 1")
    fluent("sort_desc", "lineitem", lambda q: q.select(col("l_returnflag"), sum_(col("l_quantity")).as_("quantity")).groupby(1).sortby(2, descending=True), "SELECT l_returnflag, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1 ORDER BY 2 DESC")
    service(
        "topk", QueryRequest("lineitem", L_START, L_END, Predicate("l_quantity", "MORE", [10]), ["l_suppkey"], [Metric("l_quantity", "SUM"), Metric("l_linenumber", "COUNT"), Metric("l_linenumber", "AVG")], order=Order("l_quantity", "DESC"), top=10),
        f"SELECT l_suppkey, sum(l_quantity) AS quantity, count(*) AS n, CAST(sum(l_linenumber) // count(*) AS INTEGER) AS line FROM {LINEITEM} WHERE _time_ BETWEEN {L_START} AND {L_END} AND l_quantity > 10 GROUP BY 1 ORDER BY 2 DESC, 1, 3, 4 LIMIT 10",
        {"l_quantity.SUM": "quantity", "l_linenumber.COUNT": "n", "l_linenumber.AVG": "line"},
    )
    fluent("samples_topk", "events", lambda q: q.where(col("event_type") == v("purchase")).select(col("value"), col("event_id"), col("user_id")).sortby(1, descending=True).limit(20), "SELECT value, event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id, user_id LIMIT 20")
    service("samples_default_limit", QueryRequest("customer", 0, 0, None, ["c_custkey", "c_name"], order=Order("c_custkey", "ASC")), "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100")

    def pivoted(spark, d):
        request = QueryRequest("events", START, END, None, ["event_type"], [Metric("value", "SUM")], timeline=True, window=86400)
        return pivot(engine(spark, d, "events").query(request), "event_type", "value.SUM", ["click", "view", "purchase"])

    register("pivot_metric", f"SELECT (_time_ - {START}) // 86400 * 86400 AS _window_, {', '.join(f'coalesce(sum(value) FILTER (WHERE event_type = {chr(39)}{t}{chr(39)}), 0) AS {chr(34)}{t}{chr(34)}' for t in ('click', 'view', 'purchase'))} FROM {EVENTS} WHERE _time_ BETWEEN {START} AND {END} GROUP BY 1")(pivoted)
    register("pivot_map_ratio", f"SELECT (_time_ - {START}) // 86400 * 86400 AS _window_, coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0) / nullif(coalesce(sum(value) FILTER (WHERE event_type = 'view'), 0), 0) AS ratio FROM {EVENTS} WHERE _time_ BETWEEN {START} AND {END} GROUP BY 1")(
        lambda spark, d: remove(map_columns(pivoted(spark, d), {"ratio": "click / nullif(view, 0)"}), "click", "view", "purchase")
    )
    register("custom_service", f"SELECT tens, count(*) AS n FROM (SELECT user_id // 10 AS tens FROM {EVENTS} WHERE _time_ BETWEEN {START} AND {END}) WHERE tens > 2 GROUP BY 1")(
        lambda spark, d: engine(spark, d, "events").query(QueryRequest("events", START, END, Predicate("tens", "MORE", [2]), ["tens"], [Metric("tens", "COUNT")], [Custom("tens", "LONG", "user_id div 10")], top=ALL_ROWS)).withColumnRenamed("tens.COUNT", "n")
    )

    def state(spark, d):
        s = engine(spark, d, "events").catalog.table("events").state()
        return s.select("table", "rows", "min_time", "max_time", F.array_join("dimensions", ",").alias("dimensions"), F.array_join("metrics", ",").alias("metrics"))

    register("table_state", f"SELECT 'events' AS \"table\", count(*) AS rows, min(_time_) AS min_time, max(_time_) AS max_time, 'event_type,props' AS dimensions, 'event_id,user_id,value,_time_' AS metrics FROM {EVENTS}")(state)

    def histograms(spark, d):
        h = engine(spark, d, "part").catalog.table("part").histograms()
        get = lambda p: F.get_json_object("histogram", f"$.{p}").cast("double").alias(p)
        return h.select("column", *map(get, ("count", "min", "max", "sum")))

    numbers = [f"SELECT '{c}' AS \"column\", count({x})::DOUBLE AS count, min({x})::DOUBLE AS min, max({x})::DOUBLE AS max, sum({x})::DOUBLE AS sum FROM part" for c, x in (("p_partkey", "p_partkey"), ("p_size", "p_size"), ("p_retailprice", "p_retailprice"), ("_time_", "0"))]
    texts = [f"SELECT '{c}', count({c}), NULL, NULL, NULL FROM part" for c in ("p_name", "p_brand", "p_type")]
    register("column_histogram", " UNION ALL ".join(numbers + texts))(histograms)
    register("hash_bucket", _murmur_sql("l_orderkey", 10_000, "l_orderkey, l_linenumber", "lineitem"))(lambda spark, d: source(spark, d, "lineitem").select("l_orderkey", "l_linenumber", hash_bucket(F.col("l_orderkey"), 10_000).alias("bucket")))
    register("time_spec_column", "SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS _time_ FROM orders")(_time_spec)


def _murmur_sql(key: str, buckets: int, keep: str, table: str) -> str:
    """Murmur3 of a long with seed 42, as 32 bits with a sign, modulo ``buckets``, in 32-bit steps."""
    low = lambda x: f"(({x}) % 4294967296)"
    turn = lambda x, r: f"(({x}) * {1 << r} % 4294967296 + ({x}) // {1 << (32 - r)})"
    steps = [f"(SELECT {keep}, (CAST({key} AS HUGEINT) + 18446744073709551616) % 18446744073709551616 AS key, 42::HUGEINT AS h FROM {table})"]
    for word in ("key % 4294967296", "key // 4294967296"):
        for column, value in (("k", low(f"({word}) * 3432918353")), ("k", low(f"{turn('k', 15)} * 461845907")), ("h", "xor(h, k)"), ("h", low(f"{turn('h', 13)} * 5 + 3864292196"))):
            steps.append(f"(SELECT {keep}, key, {'h, ' if column == 'k' else ''}{'k, ' if column == 'h' else ''}{value} AS {column} FROM {{}})")
    steps.append(f"(SELECT {keep}, xor(h, 8::HUGEINT) AS h FROM {{}})")
    for shift, factor in ((16, 2246822507), (13, 3266489909), (16, 1)):
        steps.append(f"(SELECT {keep}, {low(f'xor(h, h // {1 << shift}) * {factor}')} AS h FROM {{}})")
    sql = steps[0]
    for step in steps[1:]:
        sql = step.format(sql)
    return f"SELECT {keep}, CAST(((h - CASE WHEN h >= 2147483648 THEN 4294967296 ELSE 0 END) % {buckets} + {buckets}) % {buckets} AS INTEGER) AS bucket FROM {sql}"


def _time_spec(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark)
    df = source(spark, d, "orders").drop("_time_").withColumn("day", F.date_format("o_orderdate", "MM/dd/yyyy"))
    e.catalog.register("orders", df, TimeSpec("COLUMN", column="day", pattern="%m/%d/%Y"))
    return e.table("orders").select(col("o_orderkey"), col("_time_")).build()


_filters()
_projection()
_aggregation()
_timelines()
_rest()
for _name, (_run, _sql) in stored.QUERIES.items():
    register(_name, _sql)(_run)
