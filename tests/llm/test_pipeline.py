import hashlib
import os
import re

import pytest

import corpus_pipeline
from tidewheel.llm import quality, sharding
from tidewheel.llm.queries import DOMAINS, MIX_SEED, MIX_WEIGHTS, SHARDS, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_stages_against_brute_force(spark, tmp_path):
    from tests.llm import test_decontaminate, test_jaccard, test_mixing, test_sharding

    docs = table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.collect()]
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]

    def apply(name, rows):
        path = str(tmp_path / name)
        frame = spark.createDataFrame(rows, docs.schema) if rows else docs.limit(0)
        stages[name](spark, frame, SF).write.parquet(path)
        out = spark.read.parquet(path)
        assert name == "sharding" or out.columns == names
        return [tuple(r) for r in out.collect()]

    model = quality.fit(docs, table(spark, SF, "labels").where(~quality.held_out()))
    import numpy as np

    good = [r for r in rows if model.scores(np.array([quality.statistics((r[1] or "").encode())]))[0] >= 0.3]
    got = apply("quality", rows)
    assert sorted(r[0] for r in got) == sorted(r[0] for r in good) and 0 < len(got) < len(rows)

    first = {}
    for r, group in zip(got, test_jaccard.groups(got), strict=True):
        first[group] = min(first.get(group, r[0]), r[0])
    got = apply("near_duplicates", got)
    assert sorted(r[0] for r in got) == sorted(first.values())

    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = [r[0] for r, found in zip(got, test_decontaminate.brute(got, items), strict=True) if not found[-1]]
    got = apply("decontamination", got)
    assert sorted(r[0] for r in got) == sorted(clean)

    number = lambda r: re.search("([0-9]+)$", r[3] or "")
    domain = lambda r: DOMAINS[int(number(r)[1]) % 4 if number(r) else 0]
    expected = sorted(row[3] for row in test_mixing.brute(got, MIX_WEIGHTS, corpus_pipeline.MIX_RATIO, corpus_pipeline.MIX_EPOCHS, MIX_SEED, domain))
    words = {r[0]: len((r[1] or "").encode().split()) for r in got}
    got = apply("mixing", got)
    assert sorted(r[0] for r in got) == expected
    assert 0.5 * sum(words.values()) < sum(words[r[0]] for r in got) <= corpus_pipeline.MIX_RATIO * sum(words.values())

    placed = apply("sharding", got)
    lookup = test_sharding.brute(SHARDS, sharding.TABLE_SIZE)
    slot = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
    assert [(r[0], r[-2], r[-1]) for r in sorted(placed)] == [(i, slot(i), lookup[slot(i)]) for i in expected]


def test_empty(spark):
    for name, stage in corpus_pipeline.STAGES:
        docs = table(spark, SF, "documents").limit(0)
        assert stage(spark, docs, SF).count() == 0, name
