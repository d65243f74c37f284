import math

import numpy as np
from pyspark.sql import functions as F

from tidewheel.llm import maxscore


def brute(rows, k):
    """Each asking row against all other rows, those of its own id included."""
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    for at, (q, v) in enumerate(good):
        if q % 5 == 0:
            scored = sorted((-clip(sum(clip(a) * clip(b) for a, b in zip(v, w, strict=False))), i) for n, (i, w) in enumerate(good) if n != at)[:k]
            yield from ((q, n + 1, i, -s) for n, (s, i) in enumerate(scored))


def vectors(n=150, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.25, (n, d)).astype(np.float32)
    x[1::7] = x[1]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows[3] = (3, None)
    rows[4] = (4, [*rows[4][1][:-1], None])
    rows[5] = (5, [float("nan"), *rows[5][1][1:]])
    rows[6] = (6, [float("inf"), *rows[6][1][1:]])
    rows[8] = (8, [])
    rows[9] = (9, rows[9][1][:4])
    rows[15] = (15, [0.0] * d)
    # repeated ids: equal vectors, other vectors, more than k of one id
    return [*rows, rows[10], (10, rows[11][1]), *[(20, rows[20][1])] * 7, (7, rows[7][1]), (None, rows[12][1])]


COLUMNS = ["query_id", "rank", "vec_id", "score"]
SCHEMA = "vec_id long, embedding array<float>, rank int, score double, row string"


def test_against_brute_force(spark, same, monkeypatch):
    rows = vectors()
    frame = spark.createDataFrame([(*r, 0, 1.0, "x") for r in rows], SCHEMA).repartition(3)
    for shard, small, block, batch in ((8_192, 1_024, 1 << 21, 32), (40, 10, 100, 3)):
        monkeypatch.setattr(maxscore, "SHARD_ROWS", shard)
        monkeypatch.setattr(maxscore, "SMALL_SHARD", small)
        monkeypatch.setattr(maxscore, "BLOCK_COMPONENTS", block)
        monkeypatch.setattr(maxscore, "BATCH", batch)
        same(maxscore.top_k(frame, F.col("vec_id") % 5 == 0, 5), COLUMNS, brute(rows, 5))


def test_fewer_candidates_and_empty(spark, same):
    rows = [(0, [0.5, -0.5]), (1, [0.25, 0.25]), (2, [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    same(maxscore.top_k(frame, F.col("vec_id") % 5 == 0, 5), COLUMNS, brute(rows, 5))
    assert maxscore.top_k(frame.limit(0), F.lit(True), 5).count() == 0
    assert maxscore.top_k(frame, F.lit(None).cast("boolean"), 5).count() == 0


def test_huge_components(spark, same):
    rows = [(0, [1e30, 2.0]), (1, [-3e38, 5.0]), (5, [3e15, -1.0]), (7, [0.0, -2e9]), (10, [2e7, 1e7])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    same(maxscore.top_k(frame, F.col("vec_id") % 5 == 0, 5), COLUMNS, brute(rows, 5))


def test_lists_and_pruning():
    rng = np.random.default_rng(3)
    skipped = 0
    for _ in range(40):
        x = rng.integers(-40, 60, (300, 12)) * (rng.random((300, 12)) < 0.3) * np.array([50, 20, 5, *[1] * 9])
        shard = maxscore.Shard.of(np.arange(300), np.arange(300) // 2, x)
        for t in range(24):
            mine = shard.weights[shard.starts[t] : shard.starts[t + 1]]
            assert (np.diff(np.abs(mine)) <= 0).all() and (mine > 0).all() if t % 2 == 0 else (mine < 0).all()
            assert len(mine) == (x[:, t // 2] > 0 if t % 2 == 0 else x[:, t // 2] < 0).sum()
        queries = rng.integers(-30, 50, (5, 12))
        goals = [shard._seeded(7, q, 4) for q in queries]
        skipped += sum(len(shard.essential(q, g)[2]) < 12 for q, g in zip(queries, goals, strict=True))
        for j, places, scores in shard.top(np.full(5, 7), queries, 4):
            full = sorted((-int(s), i // 2, i) for i, s in enumerate(x @ queries[j]) if i != 7)[:4]
            assert [(-int(s), int(p) // 2, int(p)) for s, p in zip(scores, places, strict=True)] == full
    assert skipped > 50  # lists that weren't read
