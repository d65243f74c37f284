import pytest

from tidewheel.engine import Engine
from tidewheel.errors import AuthRequired, PermissionRequired
from tidewheel.operators.access import Access, Action, QueryContext, Rule, check, read_rules
from tidewheel.plans.expressions import col, count, max_, script, v
from tidewheel.spec import ColumnProps

MASKED = ColumnProps(rules=(Rule(Access.READ, frozenset({"pii_sg"}), Action.MASK),))
DENIED = ColumnProps(rules=(Rule(Access.READ, frozenset({"pii_sg"}), Action.DENY),))
COUNTED = ColumnProps(rules=(Rule(Access.AGGREGATION, frozenset({"money"}), Action.DENY),))


def test_rules():
    assert check(Access.READ, {"eng", "ads"}, ()) == Action.PASS
    assert check(Access.READ, {"eng"}, MASKED.rules) == Action.MASK
    assert check(Access.READ, {"eng"}, DENIED.rules) == Action.DENY
    assert check(Access.READ, {"eng", "pii_sg"}, DENIED.rules) == Action.PASS
    assert check(Access.READ, {"eng"}, (*MASKED.rules, *DENIED.rules)) == Action.DENY
    for word in ("aggregation", "aggregate"):
        assert read_rules({word: {"groups": ["a"], "action": "deny"}}) == (Rule(Access.AGGREGATION, frozenset({"a"}), Action.DENY),)
    assert read_rules({"read": {"groups": ["a"], "action": "what"}})[0].action == Action.PASS


@pytest.fixture(scope="module")
def table(spark):
    e = Engine(spark)
    df = spark.createDataFrame([(1, "x", "a@b.c", 5), (2, "y", "d@e.f", 9)], "id int, event string, email string, fund long")
    e.catalog.register("t", df, columns={"email": MASKED, "fund": DENIED, "id": COUNTED})
    return e.table("t")


ME, MEMBER = QueryContext.of("me", ["eng"]), QueryContext.of("you", ["pii_sg"])


def test_masks(table):
    q = table.select(col("id"), col("event"), col("email"))
    assert {tuple(r) for r in q.build(ME).collect()} == {(1, "x", "***"), (2, "y", "***")}
    assert {tuple(r) for r in q.build(MEMBER).collect()} == {(1, "x", "a@b.c"), (2, "y", "d@e.f")}
    assert [tuple(r) for r in table.select(col("email"), count(v(1)).as_("n")).groupby(1).build(ME).collect()] == [("***", 2)]
    assert {r[0] for r in table.select(script("m", __import__("pyspark.sql.types", fromlist=["t"]).StringType(), "upper(email)")).build(ME).collect()} == {"***"}


def test_denials(table):
    from pyspark.sql import types as T

    for q in (
        table.select(col("fund")), table.select(col("*")), table.select(col("event"), max_(col("fund")).as_("m")), table.select(col("event"), max_(col("email")).as_("m")),
        table.where(col("email") == "a@b.c").select(col("event")), table.where(col("fund") > 3).select(col("event")), table.select(max_(col("id")).as_("m")),
        table.apply("half", T.LongType(), "fund div 2").select(col("half")), table.apply("half", T.LongType(), "fund div 2").apply("q", T.LongType(), "half div 2").where(col("q") > 0).select(col("event")),
    ):
        with pytest.raises(PermissionRequired):
            q.build(ME)
    assert table.select(col("event"), max_(col("fund")).as_("m")).build(MEMBER).count() == 2


def test_tables_and_login(spark):
    e = Engine(spark)
    e.catalog.register("t", spark.range(3).toDF("n"), rules=[Rule(Access.READ, frozenset({"a"}), Action.DENY)])
    with pytest.raises(PermissionRequired):
        e.table("t").select(col("n")).build(ME)
    assert e.table("t").select(col("n")).build(QueryContext.of("x", ["a"])).count() == 3
    with pytest.raises(AuthRequired):
        e.table("t").select(col("n")).build(QueryContext.of("x", (), auth_required=True))


def test_computed_columns_are_resolved(spark, table):
    from pyspark.sql import types as T

    from tidewheel.errors import FailCompileQuery
    from tidewheel.plans.request import Custom, Metric, Predicate, QueryRequest

    spark.range(1).createOrReplaceTempView("anything")
    text = lambda sql, name="x": table.apply(name, T.StringType(), sql)
    # another spelling, a script over a script, and a column replaced by a script: masked or refused like the column itself
    for q in (text("upper(EMAIL)"), text("`eMail`"), text("() => t.column('EMAIL')"), text("concat(email, '')", "y").apply("x", T.StringType(), "reverse(Y)"), text("upper(email)", "EVENT").apply("x", T.StringType(), "event")):
        assert {r[0] for r in q.select(col("x")).build(ME).collect()} == {"***"}
        assert "***" not in {r[0] for r in q.select(col("x")).build(MEMBER).collect()}
        with pytest.raises(PermissionRequired):
            q.where(col("x") == "A@B.C").select(col("id")).build(ME)
        with pytest.raises(PermissionRequired):
            q.select(max_(col("x")).as_("m")).build(ME)
    with pytest.raises(PermissionRequired):
        table.apply("f", T.LongType(), lambda x: x, ["FUND"]).select(col("f")).build(ME)
    with pytest.raises(PermissionRequired):
        table.where(script("s", T.LongType(), "FUND") > 1).select(col("event")).build(ME)
    refused = ("to_json(struct(*))", "(select max(id) from anything)", "exists(select 1)", "java_method('java.lang.System', 'getProperty', 'user.home')", "reflect('java.lang.System', 'getProperty', 'user.home')", "identifier('reflect')('a', 'b')", "current_user()", "max(email)", "no_such_function(1)", "no_such_column")
    for sql in refused:
        for context in (ME, MEMBER):
            with pytest.raises(FailCompileQuery):
                text(sql).select(col("x")).build(context)
    e = Engine(spark)
    e.catalog.register("t", table.table.source, columns=table.table.column_props)
    ask = lambda sql, **more: QueryRequest("t", 0, 1, more.pop("filter", None), ["x"], more.pop("metrics", ()), [Custom("x", "STRING", sql)])
    assert {r[0] for r in e.query(ask("upper(EMAIL)"), ME).collect()} == {"***"}
    for request, error in ((ask("upper(FUND)"), PermissionRequired), (ask("upper(EMAIL)", filter=Predicate("x", "LIKE", ["A%"])), PermissionRequired), *((ask(sql), FailCompileQuery) for sql in refused)):
        with pytest.raises(error):
            e.query(request, ME)


def test_nothing_runs_before_the_check(spark):
    from pyspark.sql import functions as F

    from tidewheel.plans.request import Metric, QueryRequest

    e = Engine(spark)
    fails = spark.range(3).select(F.raise_error(F.lit("it ran")).cast("long").alias("n"), F.lit(0).cast("long").alias("_time_"))
    e.catalog.register("t", fails, columns={"N": DENIED})
    with pytest.raises(PermissionRequired):
        e.query(QueryRequest("t", 0, 1, None, (), [Metric("n", "HIST")]), ME)


def test_registered_functions(spark):
    from pyspark.sql import types as T

    e = Engine(spark)
    e.register_function("thrice", lambda x: x * 3, "long")
    e.catalog.register("t", spark.range(3).toDF("n"))
    assert sorted(r[0] for r in e.table("t").apply("x", T.LongType(), "thrice(n)").select(col("x")).build(ME).collect()) == [0, 3, 6]
