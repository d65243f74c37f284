import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import quality

SF = "/root/testdata/sf0.01"


def test_discriminant_against_densities():
    rng = np.random.default_rng(0)
    d = len(quality.STATISTICS)
    x = {0: rng.normal(0, 1, (400, d)), 1: rng.normal(0.5, 2, (300, d))}
    sums = {k: (float(len(v)), v.sum(0), v.T @ v) for k, v in x.items()}
    model = quality.discriminant(sums, pooled=0.0, ridge=0.0, temperature=1.0)
    probe = rng.normal(0, 1.5, (50, d))
    logs = []
    for k in (0, 1):
        mean, cov = x[k].mean(0), np.cov(x[k].T, bias=True)
        z = probe - mean
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) - 0.5 * np.linalg.slogdet(cov)[1] + np.log((len(x[k]) + 1) / 702))
    assert np.allclose(model.scores(probe), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-6)


def test_edges(spark, docs, nothing):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 1), (3, None, 0), (None, 1, 0), (4, 7, 0), (5, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0), labels.where("quality = 1")):
        scored = quality.score(docs, quality.fit(docs, given))
        row = scored.agg(F.count(F.lit(1)), F.min("score"), F.max("score"), F.count("score")).first()
        assert row[0] == row[3] == docs.count() and 0 <= row[1] <= row[2] <= 1
    model = quality.fit(nothing, labels)
    assert quality.score(nothing, model).count() == 0
    assert quality.keep_good(docs, model, 0.5).columns == docs.columns
    assert len(quality.statistics(b"")) == len(quality.statistics(b"\n \n")) == len(quality.STATISTICS)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_accuracy(spark):
    from tidewheel.llm.queries import op2_quality_discriminant

    scored = op2_quality_discriminant(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    rows = scored.collect()
    assert len(rows) > 40
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
