"""The registered queries: one per operator, with the contracts' columns, and equal to their SQL where they have one."""

import os

import duckdb
import pytest

from tidewheel.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "labels", "benchmark")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")

COLUMNS = {
    1: {"doc_id": "bigint", "domain": "string", "lang": "string", "source": "string", "epoch": "bigint", "n_tokens": "bigint"},
    2: {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    3: {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    4: {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    5: {"doc_id": "bigint", "slot": "int", "shard": "int"},
    6: {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    7: {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    8: {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    9: {"doc_id": "bigint", "n_lines": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    10: {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string", "n_spans": "bigint"},
}


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    number = int(name[2:].split("_")[0])
    df = QUERIES[name](spark, SF)
    assert dict(df.dtypes) == COLUMNS[number]
    rows = df.collect()
    if number not in (1, 4):
        ids = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
        assert sorted(r.doc_id for r in rows) == sorted(ids)
    if name in ORACLES:
        connection = duckdb.connect()
        for t in TABLES:
            connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        names = df.columns
        expected = connection.execute(f"select {', '.join(names)} from ({ORACLES[name]})").fetchall()
        assert sorted(map(str, map(tuple, rows))) == sorted(map(str, expected))
