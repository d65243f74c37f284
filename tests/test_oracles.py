"""Every registered query of the engine runs, and agrees with its SQL in another engine."""

import os

import duckdb
import pytest

from tidewheel.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


def plain(rows, order):
    out = []
    for r in rows:
        out.append(tuple(round(float(x), 6) if isinstance(x, float) else x if x is None or isinstance(x, int | str | bool) else str(x) for x in (r[i] for i in order)))
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    answer = duck.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    expected = answer.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert plain(rows, sorted(range(len(df.columns)), key=lambda i: df.columns[i])) == plain(expected, sorted(range(len(names)), key=lambda i: names[i]))


def test_json_documents_of_many_partitions(spark, duck):
    """As over large tables, the nations come from several partitions."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = QUERIES["source_json_document"](spark, SF)
        assert len(df.inputFiles()) >= 25  # a document each
        got = plain(df.collect(), range(3))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == plain(duck.execute(ORACLES["source_json_document"]).fetchall(), range(3))


def test_json_documents_of_bounded_size(spark, duck, monkeypatch):
    """A nation's customers are several documents, once they are many."""
    monkeypatch.setattr("tidewheel.queries.stored.PAGED", 40)
    df = QUERIES["source_json_document"](spark, SF)
    customers, nations = duck.execute("select count(*), count(distinct c_nationkey) from customer").fetchone()
    assert customers > 80 and len(df.inputFiles()) > nations + 1
    assert plain(df.collect(), range(3)) == plain(duck.execute(ORACLES["source_json_document"]).fetchall(), range(3))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_llm_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
