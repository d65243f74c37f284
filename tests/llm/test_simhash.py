import itertools

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewheel.llm import simhash
from tidewheel.llm.components import connected_components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = (text or "").translate(LOW).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows):
    prints = [(r[0], fingerprint(r[1])) for r in rows]
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
            parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return [(doc, f"{fp:016x}", least.get(root(i))) for i, (doc, fp) in enumerate(prints)]


def test_against_brute_force(docs, rows, same):
    for pairs_per_key in (simhash.PAIRS_PER_KEY, 6, 0):  # by pairs; under refined keys, too; by midpoints
        same(simhash.near_duplicates(docs, pairs_per_key=pairs_per_key), ["doc_id", "fingerprint", "component_id"], components(rows))


def test_empty(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.representatives(nothing).count() == 0


def test_representatives(docs, rows, same):
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    groups = {}
    for row, (doc, fp, component) in zip(rows, components(rows), strict=True):
        groups.setdefault(component if component is not None else fp, []).append(row)
    least = [min((r[0] for r in g if r[0] is not None), default=None) for g in groups.values()]
    order = lambda x: (x is not None, x)
    assert sorted((r.doc_id for r in kept.collect()), key=order) == sorted(least, key=order)


def test_every_word_is_near_a_codeword():
    words = np.random.default_rng(1).integers(0, 1 << 23, 20_000)
    low, high, errors = simhash.golay_tables()
    distance = np.bitwise_count(errors[low[words & 2047] ^ high[words >> 11]])
    assert distance.max() == 3 and len(np.unique(simhash.codeword_index(words))) <= 4096


@settings(max_examples=200, deadline=None)
@given(st.integers(0, (1 << 64) - 1), st.lists(st.integers(0, 63), max_size=2))
def test_linked_fingerprints_meet(a, flips):
    b = a
    for f in flips:
        b ^= 1 << f
    key, row, probe = simhash.key_rows(np.array([a, b], np.uint64).view(np.int64))
    filed = set(key[(row == 0) & ~probe].tolist())
    asked = set(key[(row == 1) & probe].tolist())
    assert filed & asked
    fine, at = simhash.refined_rows(key, np.array([a, b], np.uint64).view(np.int64)[row])
    assert set(fine[(row[at] == 0) & ~probe[at]].tolist()) & set(fine[(row[at] == 1) & probe[at]].tolist())


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (7, 7), (20, 5), (6, 20)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.root) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (10, 10), (11, 10), (5, 5), (6, 5), (20, 5)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in connected_components(chain).collect()} == {0}
