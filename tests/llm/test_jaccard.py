import itertools

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import ordered
from tidewheel.llm import jaccard, simhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = (text or "").translate(LOW).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


@pytest.mark.parametrize("pairs_per_bucket", [jaccard.PAIRS_PER_BUCKET, 0])
def test_against_brute_force(docs, rows, pairs_per_bucket):
    kept = simhash.similar_representatives(docs, pairs_per_bucket=pairs_per_bucket)
    assert kept.columns == docs.columns
    least = {}
    for r, g in zip(rows, groups(rows), strict=True):
        least.setdefault(g, []).append(r[0])
    expected = [min((i for i in ids if i is not None), default=None) for ids in least.values()]
    assert ordered([(r.doc_id,) for r in kept.collect()]) == ordered([(i,) for i in expected])


def near(k, total=80):
    """``total`` words, the k-th changed."""
    return " ".join(f"w{i}" if i != k else f"changed{k}" for i in range(total))


def test_stage_of_the_pipeline(spark):
    texts = [near(None), near(40), near(20), "other " + near(None, 30), "other " + " ".join(near(15, 30).split())]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    # 71 of 81 shingles are common: 0.88; of the last two, 22 of 32
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == [0, 3, 4]


def test_crowded_bucket(spark):
    """Copies with two changed words each: many pairs are below the threshold, chains join all but the outsider."""
    texts = [" ".join(f"w{i}" if i not in (2 * k, 2 * k + 1) else f"x{k}" for i in range(120)) for k in range(60)]
    texts.append(" ".join(f"w{i}" if i % 12 else f"y{i}" for i in range(120)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    least = {}
    for i, g in enumerate(groups([(i, t) for i, t in enumerate(texts)])):
        least.setdefault(g, i)
    for pairs_per_bucket in (10, 100_000):
        assert sorted(r.doc_id for r in simhash.similar_representatives(docs, pairs_per_bucket=pairs_per_bucket).collect()) == sorted(least.values())


def test_tests_before_the_sets_lose_no_pair():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 3000))
        common = rng.integers(0, 1 << 64, n, np.uint64)
        a, b = (np.unique(np.concatenate((common, rng.integers(0, 1 << 64, int(rng.integers(0, n // 8 + 2)), np.uint64)))) for _ in range(2))
        near = 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
        x, y = jaccard.parities([a, b])
        cells = sum(((p ^ q) & ((1 << 64) - 1)).bit_count() for p, q in zip(x, y, strict=True))
        assert len(x) == jaccard.PARITY_BITS // 64 and cells <= len(np.setxor1d(a, b))
        assert not near or (9 * cells <= len(a) + len(b) and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)))


def test_empty(nothing):
    assert simhash.similar_representatives(nothing).count() == 0
