"""Jaccard similarity of word shingles, for SimHash's groups of similar texts.

Two texts are near-duplicates where the sets of their five-word shingles have a similarity of 0.8 or more. Texts of equal sets are one
node. Nodes that may be near meet in buckets; MinHash gives such buckets: one for each of BANDS bands of ROWS minima. What meets is
verified on the sets themselves, so no link is below the threshold. A pair at similarity s meets in no band with probability
(1 - s^ROWS)^BANDS: 0.0004 at 0.8, under 1e-6 at 0.9.

Before that, a pair must pass two tests that no near-duplicates fail: the sets' sizes, and the parities of their shingles over PARITY_BITS
cells, since cells that differ can't be more than the shingles that do.

In a bucket of few nodes all pairs are tested. In a crowded one only what joins components matters: for a few rounds, nodes are held
against one member of their bucket, and those in its component by then are left out. At last all pairs that are still in different
components are tested, so crowded buckets link all that small ones would.
"""

from __future__ import annotations

import itertools

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap_pieces, cut, digest, map_texts, possible
from .components import connected_components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BANDS, ROWS = 20, 5
#: A bucket in which more pairs than this would meet is crowded.
PAIRS_PER_BUCKET = 1024
#: Rounds of one member against the others of a crowded bucket.
ROUNDS = 3
PARITY_BITS = 1024

_RANDOM = np.random.default_rng(42)
_FACTORS, _TERMS = (_RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
_FACTORS |= np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 (seed 42) of the text's word shingles, repeats included; fewer words: of the whole sequence; none: none."""
    found = text.translate(LOWER).split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = list(itertools.accumulate(map(len, found)))
    digest, last = xxhash.xxh64_intdigest, words - 1
    return [digest(joined[e - n + i : ends[i + last] + i + last], 42) for i, (e, n) in enumerate(zip(ends, map(len, found[: len(found) - last]), strict=False))]


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    return [np.unique(np.array(shingle_hashes(t, words), np.uint64)) for t in texts]


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Per set, which mustn't be empty, a key for each band."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = (key ^ np.minimum.reduceat(flat * _FACTORS[k] + _TERMS[k], starts)) * _MIX
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys.view(np.int64)


def parities(sets: list[np.ndarray]) -> list[list[int]]:
    """Per set which cells hold an odd number of its shingles, as longs."""
    odd = (np.bincount((s >> np.uint64(40)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1 for s in sets)
    return [np.packbits(x.astype(bool)).view(np.int64).tolist() for x in odd]


def _sets(docs: DataFrame, picks: DataFrame, words: int) -> DataFrame:
    """``node`` and ``hashes`` of the rows named by ``picks`` (node, id, name)."""

    def work(cols: dict) -> dict:
        return {"node": cols["node"], "hashes": [s.view(np.int64).tolist() for s in shingle_sets(cols["text"], words)]}

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"), "text")
    marked = possible(own, F.xxhash64("doc_id", "digest"), bitmap_pieces(picks.select(F.xxhash64("id", "name").alias("key"))))
    picked = marked.where("__maybe").join(picks, F.expr("doc_id <=> id and digest = name")).select("node", "text")
    return cut(map_texts(picked, work, "node long, hashes array<long>").dropDuplicates(["node"]))  # rows equal in id and text


def _close(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can have a similarity of 0.8."""
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _may_be_near(other: str) -> Column:
    """Whether this side's and ``other``'s sets can be near: of sizes, and of cells that differ, of which there are (n + m) / 9 at most."""
    return _close(F.col("n"), F.col(f"n_{other}")) & F.expr(f"9 * aggregate(zip_with(parity, parity_{other}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) <= n + n_{other}")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of similarity 0.8 or more: with i common shingles, i / (n + m - i) >= 4 / 5."""
    own = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met = own.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return cut(met.where("9 * size(array_intersect(x, y)) >= 4 * (size(x) + size(y))").select("a", "b"))


def linked(docs: DataFrame, nodes: DataFrame, keys: DataFrame, words: int, pairs_per_bucket: int = PAIRS_PER_BUCKET) -> DataFrame:
    """``node`` and ``root`` of every node with a link to another.

    ``nodes``: ``node``, ``row`` (last, doc_id, digest: a document that has the set), ``n`` (shingles), ``parity``. ``keys``: ``node`` and ``key``,
    the buckets in which it meets others.
    """
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    inside = cut(keys.join(sizes, "key").select("key", "members", "node"))
    met = cut(inside.join(nodes.select("node", "n", "parity"), "node"))
    picks = cut(nodes.join(inside.select("node").distinct(), "node").select("node", F.col("row.doc_id").alias("id"), F.col("row.digest").alias("name")))
    sets = _sets(docs, picks, words)

    crowded = F.col("members") * (F.col("members") - 1) / 2 > pairs_per_bucket
    few, crowd = met.where(~crowded), met.where(crowded)
    renamed = lambda df, *more: df.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("parity_b"), *more)
    pairs = few.withColumnRenamed("node", "a").join(renamed(few), "key").where(F.expr("a < b") & _may_be_near("b"))
    edges = _verified(pairs.select("a", "b"), sets)
    if crowd.isEmpty():
        return connected_components(edges)
    for turn in range(ROUNDS + 1):
        component = connected_components(edges)
        placed = cut(crowd.join(component, "node", "left").select("key", "node", "n", "parity", F.coalesce("root", "node").alias("root")))
        center = F.min_by(F.struct("node", "n", "parity", "root"), F.xxhash64("node", F.lit(turn))).alias("center")
        apart = cut(placed.groupBy("key").agg(F.count_distinct("root").alias("roots"), center).where("roots > 1").select("key", "center"))
        if apart.isEmpty():
            return component
        if turn < ROUNDS:
            others = apart.select("key", *(F.col(f"center.{c}").alias(d) for c, d in (("node", "b"), ("n", "n_b"), ("parity", "parity_b"), ("root", "root_b"))))
            tested = placed.join(others, "key").where(F.expr("root <> root_b") & _may_be_near("b"))
        else:
            rest = cut(placed.join(apart.select("key"), "key"))
            tested = rest.join(renamed(rest, F.col("root").alias("root_b")), "key").where(F.expr("root < root_b") & _may_be_near("b"))
        edges = edges.union(_verified(tested.select(F.col("node").alias("a"), "b"), sets))
    return connected_components(edges)
