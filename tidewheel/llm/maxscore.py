"""Exact top-k by inner product of integer vectors with MaxScore.

A vector is a document; a dimension with a sign is a term. A term's postings are the vectors whose component has that sign, sorted by
weight, the largest first, so its first weight bounds them all. A query's component gains from the postings of its own sign and loses by
those of the other one.

Vectors are dealt into shards of bounded size, and each shard's postings are one row of an index table, written once; it stays where it is.
Queries come in blocks of bounded size, broadcast one after the other, and meet each shard as a scan. Per query and shard:

* The heads of the longest-reaching postings are scored first; their k-th score is what a vector must reach.
* Terms are sorted by their bounds. The longest tail whose bounds sum to less than that score is non-essential: a vector outside all
  essential postings can't get in.
* Essential dimensions are traversed posting by posting, both signs, adding up scores.
* A vector whose score so far and the tail's bounds can compete is probed on the other dimensions, largest bound first, and dropped as soon
  as it can't.

The shards' lists are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, releases

#: Vectors in a shard, about. Few vectors are dealt into smaller shards, so that all cores have work.
SHARD_ROWS, SMALL_SHARD = 8_192, 1_024
#: Components of the queries in a block, about: 16 MB.
BLOCK_COMPONENTS = 1 << 21
#: Queries that go through a shard at once, and postings at a list's head that are scored first.
BATCH, SEEDS = 32, 16
LONG = np.iinfo(np.int64)


def floored(embedding: Column) -> Column:
    """floor(256 * x) of each component as double; null where the vector or a component is null, or one is not finite. What is beyond a long
    is its end."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(good, F.transform(embedding, lambda x: F.floor(x.cast("double") * 256).cast("long")))


def _narrow(values: np.ndarray) -> np.ndarray:
    """Integers in the smallest type that holds them."""
    return next((values.astype(t) for t in (np.int16, np.int32) if not values.size or np.iinfo(t).min <= values.min() and values.max() <= np.iinfo(t).max), values)


class Shard:
    """Postings of some vectors: for dimension d the terms 2 d (positive) and 2 d + 1 (negative)."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, starts: np.ndarray, docs: np.ndarray, weights: np.ndarray):
        self.rows, self.ids, self.vectors, self.starts, self.docs, self.weights = rows, ids, vectors, starts, docs, weights
        heads = starts[:-1]
        self.bounds = np.zeros(len(heads), np.int64)  # the first of each list is its largest
        full = starts[1:] > heads
        self.bounds[full] = weights[heads[full]]

    @staticmethod
    def of(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> Shard:
        docs, weights, starts = [], [], [0]
        for column in vectors.T:
            for sign in (1, -1):
                found = np.nonzero(column > 0 if sign > 0 else column < 0)[0]
                found = found[np.argsort(-np.abs(column[found].astype(np.float64)), kind="stable")]
                docs.append(found)
                weights.append(column[found])
                starts.append(starts[-1] + len(found))
        flat = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        return Shard(rows, ids, _narrow(vectors), np.array(starts, np.int64), _narrow(flat(docs)), _narrow(flat(weights)))

    def essential(self, query: np.ndarray, goal: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A query's dimensions by falling bounds, what each and the later ones can add (a 0 at the end), and which are essential."""
        bounds = query * np.where(query >= 0, self.bounds[0::2], self.bounds[1::2])
        order = np.argsort(-bounds, kind="stable")
        behind = np.concatenate((np.cumsum(bounds[order][::-1])[::-1], [0]))
        need = len(order) if goal is None else int(np.searchsorted(-behind, -goal, side="right"))
        return order, behind, order[: min(need, len(order))]

    def _seeded(self, own: int, query: np.ndarray, k: int) -> float | None:
        """The k-th score among the heads of the lists that reach furthest; none, if it isn't positive, since vectors in no list score 0."""
        order = self.essential(query, None)[0][:4]
        lists = [2 * d + (query[d] < 0) for d in order.tolist() if query[d]]
        found = np.unique(np.concatenate([self.docs[self.starts[t] : min(self.starts[t] + SEEDS, self.starts[t + 1])] for t in lists])) if lists else np.empty(0, np.int64)
        found = found[self.rows[found] != own]
        if len(found) < k:
            return None
        goal = np.sort(self.vectors[found].astype(np.int64) @ query)[-k]
        return goal if goal > 0 else None

    def top(self, owns: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query (a row of int64) its number, and places and scores of its k best vectors but the row ``owns`` says, ties to smaller
        ids."""
        goals = [self._seeded(own, q, k) for own, q in zip(owns.tolist(), queries, strict=True)]
        plans = [self.essential(q, g) for q, g in zip(queries, goals, strict=True)]
        part = np.zeros(queries.shape, np.int64)  # the queries on their essential dimensions
        for j, (_, _, dims) in enumerate(plans):
            part[j, dims] = queries[j, dims]
        scores = np.zeros((len(self.ids), len(queries)), np.int64)
        for d in np.nonzero(part.any(axis=0))[0].tolist():
            at = slice(self.starts[2 * d], self.starts[2 * d + 2])  # both signs, one list after the other
            scores[self.docs[at]] += self.weights[at].astype(np.int64)[:, None] * part[:, d]
        for j, (order, behind, dims) in enumerate(plans):
            goal, n = goals[j], len(dims)
            alive = np.arange(len(self.ids)) if goal is None else np.nonzero(scores[:, j] + behind[n] >= goal)[0]
            alive = alive[self.rows[alive] != owns[j]]
            score = scores[alive, j]
            for t in range(n, len(order)):
                if not len(alive):
                    break
                score = score + self.vectors[alive, order[t]].astype(np.int64) * queries[j, order[t]]
                keep = score + behind[t + 1] >= goal
                alive, score = alive[keep], score[keep]
            best = np.lexsort((self.rows[alive], self.ids[alive], -score))[:k]
            yield j, alive[best], score[best]

    def top_wide(self, owns: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``top`` where sums may not fit 64 bits: exact, without bounds; scores beyond a long are its ends."""
        wide = self.vectors.astype(object)
        for j, (own, query) in enumerate(zip(owns.tolist(), queries, strict=True)):
            full = (wide * query.astype(object)).sum(axis=1) if query.size else np.zeros(len(wide), object)
            score = np.array([min(max(int(s), LONG.min), LONG.max) for s in full], np.int64)
            alive = np.nonzero(self.rows != own)[0]
            best = sorted(alive.tolist(), key=lambda i: (-int(score[i]), int(self.ids[i]), int(self.rows[i])))[:k]
            yield j, np.array(best, np.int64), score[best]


_ARRAYS = ("rows", "ids", "vectors", "starts", "docs", "weights")
_INDEX = "n int, width int, " + ", ".join(f"{a} binary, {a}_type string" for a in _ARRAYS)


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Vectors of different lengths, padded with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _index(rows: DataFrame, shards: int) -> DataFrame:
    """The shards' postings, one row each, written as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard() -> pa.RecordBatch:
            width = max(map(len, vectors))
            made = Shard.of(np.array(numbers, np.int64), np.array(ids, np.int64), _matrix(vectors, width))
            out = {"n": [len(ids)], "width": [width]}
            for a in _ARRAYS:
                out |= {a: [np.ascontiguousarray(getattr(made, a)).tobytes()], f"{a}_type": [getattr(made, a).dtype.str]}
            return pa.RecordBatch.from_pydict(out, pa.schema([("n", pa.int32()), ("width", pa.int32()), *((x, t) for a in _ARRAYS for x, t in ((a, pa.binary()), (f"{a}_type", pa.string())))]))

        numbers, ids, vectors = [], [], []
        for batch in batches:
            numbers, ids, vectors = numbers + batch.column(0).to_pylist(), ids + batch.column(1).to_pylist(), vectors + batch.column(2).to_pylist()
            if len(ids) >= SHARD_ROWS:
                yield shard()
                numbers, ids, vectors = [], [], []
        if ids:
            yield shard()

    return cut(rows.select("row", "vec_id", "vector").repartition(shards, "row").mapInArrow(run, _INDEX))


def _read(row: dict) -> Shard:
    parts = {a: np.frombuffer(row[a], np.dtype(row[f"{a}_type"])) for a in _ARRAYS}
    return Shard(**parts | {"vectors": parts["vectors"].reshape(row["n"], row["width"])})


def _search(index: DataFrame, block: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> DataFrame:
    """One block of queries (rows, ids, vectors) against all shards."""
    sent = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns, query_ids, every = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                shard = _read(row)
                width = max(shard.vectors.shape[1], every.shape[1])
                if width > shard.vectors.shape[1]:  # what only queries have scores nothing
                    every = every[:, : shard.vectors.shape[1]]
                queries = np.zeros((len(every), shard.vectors.shape[1]), np.int64)
                queries[:, : every.shape[1]] = every
                most = lambda x: max(-int(x.min(initial=0)), int(x.max(initial=0)))
                fits = most(queries) * most(shard.vectors) * max(1, queries.shape[1]) < 1 << 62
                found: list[tuple] = []
                for at in range(0, len(queries), BATCH):
                    few = slice(at, at + BATCH)
                    for j, places, scores in (shard.top if fits else shard.top_wide)(owns[few], queries[few], k):
                        n = len(places)
                        found.append((np.full(n, owns[at + j]), np.full(n, query_ids[at + j]), shard.rows[places], shard.ids[places], scores))
                columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["own", "query_id", "row", "vec_id", "score"])

    # each row is a whole shard
    return index.repartition(max(1, index.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, "own long, query_id long, row long, vec_id long, score long")


@releases
def top_k(vectors: DataFrame, query: Column, k: int = 5) -> DataFrame:
    """The k best partners of each row of ``vectors`` (vec_id, embedding) for which ``query`` holds, among all rows but itself.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``, ties to smaller vec_id; fewer than k where there are fewer.

    Rows with a null id, a null vector, or null or non-finite components take no part. Rows that share an id are rows of their own: each is a
    candidate to all others, those of its id included, and each that asks gets a list of its own under that id. Empty vectors
    score 0; vectors of different lengths are padded with zeros. Components and scores beyond a long are its ends. Empty tables give empty
    results. Extra columns are left out.
    """
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), floored(F.col("embedding")).alias("vector"), query.alias("asks")).where("vec_id is not null and vector is not null")
    rows = cut(good.withColumn("row", F.monotonically_increasing_id()))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("asks"), F.size("vector") + 1)), F.lit(0)).alias("asked")).first()
    shards = max(1, -(-sizes["n"] // SHARD_ROWS), min(32, sizes["n"] // SMALL_SHARD))
    blocks = -(-sizes["asked"] // BLOCK_COMPONENTS)
    asked = cut(rows.where("asks").select("row", "vec_id", "vector", F.pmod(F.xxhash64("row"), F.lit(max(1, blocks))).alias("block")))
    index = _index(rows, shards)
    spark, found = vectors.sparkSession, []
    for b in range(blocks):
        mine = asked.where(F.col("block") == b).select("row", "vec_id", "vector").toArrow()  # a block's queries
        lists = mine.column("vector").to_pylist()
        block = (mine.column("row").to_numpy(), mine.column("vec_id").to_numpy(), _matrix(lists, max(map(len, lists), default=0)))
        found.append(cut(_search(index, block, k)))
    every = spark.createDataFrame([], "own long, query_id long, row long, vec_id long, score long")
    for part in found:
        every = every.unionByName(part)
    best = W.partitionBy("own").orderBy(F.desc("score"), "vec_id", "row")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
