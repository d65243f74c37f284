"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Of two fingerprints that differ in at most
two bits, one segment is equal and another differs in at most one bit (pigeonhole). Segments are words of the perfect
(23, 12) Golay code: each is within three bits of exactly one of 4096 codewords. A word's own codeword, and the
codewords nearest to its 23 neighbours (one or six in all), give its keys: of two words that differ in one bit,
the own codeword of either is among the keys of the other. So a key is an equal segment plus a codeword index of
another one; each fingerprint is filed under 6 keys and looked up under 6 to 36. Pairs that meet are verified.

A key under which many distinct fingerprints meet is refined: the third segments of a linked pair differ in at most two bits, so a word
between them is within one bit of both, and its codeword's index is among the keys of either. That leaves a key an equal segment and two
codeword indices. Where even these hold too many, as in a dense cloud, all pairs would grow with the square of their number; two
fingerprints that differ in at most two bits both lie within one bit of some 64-bit point, and of each point's 65 possible neighbours all
link to the smallest. This is exact and linear.

Texts of similar shingle sets (Jaccard, 0.8 or more) lie up to a dozen bits apart, beyond the reach of such codes. For these groups,
fingerprints that link are buckets of candidates beside those of MinHash, and every link is verified on the sets.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import cut, digest, map_texts, packed, releases, without
from .components import connected_components
from .jaccard import shingle_hashes

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # shift and width
#: A key under which more pairs than this would meet is refined, and a refined one goes the way of the midpoints.
PAIRS_PER_KEY = 1024
#: Words in a shingle of similar texts.
SIMILAR_WORDS = 5
#: Generator polynomial of the (23, 12) Golay code.
GOLAY = 0b101011100011


@functools.cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 11 and the high 12 bits of a 23-bit word, and the error of each syndrome."""
    unit = []
    for i in range(23):
        x = 1 << i
        for top in range(22, 10, -1):
            if x >> top & 1:
                x ^= GOLAY << (top - 11)
        unit.append(x)

    def syndromes(first: int, bits: int) -> np.ndarray:
        out = np.zeros(1 << bits, np.int64)
        for i in range(bits):
            out[1 << i : 2 << i] = out[: 1 << i] ^ unit[first + i]
        return out

    low, high, errors = syndromes(0, 11), syndromes(11, 12), np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        for bits in itertools.combinations(range(23), weight):
            word = sum(1 << b for b in bits)
            errors[low[word & 2047] ^ high[word >> 11]] = word
    return low, high, errors


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    low, high, errors = golay_tables()
    return (words ^ errors[low[words & 2047] ^ high[words >> 11]]) >> 11


def fuzzy_indices(words: np.ndarray) -> np.ndarray:
    """Per word the 24 indices of itself and its neighbours, sorted; repeats are -1."""
    flips = np.concatenate(([0], 1 << np.arange(23, dtype=np.int64)))
    found = np.sort(codeword_index(words[:, None] ^ flips), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def key_rows(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of int64 fingerprints: (key, position of the fingerprint, whether it looks up or is filed)."""
    unsigned = prints.view(np.uint64)
    parts = [(unsigned >> np.uint64(s)).astype(np.int64) & ((1 << w) - 1) for s, w in SEGMENTS]
    keys, rows, probes = [], [], []
    at = np.arange(len(prints))
    for table, (i, j) in enumerate(itertools.permutations(range(3), 2)):
        base = (np.int64(table) << 36) | (parts[i] << 12)
        keys.append(base | codeword_index(parts[j]))
        rows.append(at)
        probes.append(np.zeros(len(at), bool))
        near = fuzzy_indices(parts[j])
        r, c = np.nonzero(near >= 0)
        keys.append(base[r] | near[r, c])
        rows.append(r)
        probes.append(np.ones(len(r), bool))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(probes)


_SPREAD = np.array([sum((b >> j & 1) << (8 * j) for j in range(8)) for b in range(256)], np.uint64)


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document the 64 bits that are set in over half of its hashes; ``counts`` of 0 give 0."""
    out = np.zeros(len(counts), np.uint64)
    full = np.nonzero(counts)[0]
    if not len(full):
        return out.view(np.int64)
    n = counts[full]
    first = np.cumsum(n) - n
    blocks = -(-n // 255)  # bytes hold up to 255
    block_first = np.cumsum(blocks) - blocks
    starts = np.repeat(first, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(block_first, blocks))
    for k in range(8):
        lanes = np.add.reduceat(_SPREAD[(hashes >> np.uint64(8 * k)).astype(np.uint8)], starts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), block_first, axis=0)
        bits = (2 * sums > n[:, None]).astype(np.uint64)
        out[full] |= (bits << (np.arange(8, dtype=np.uint64) + np.uint64(8 * k))).sum(axis=1, dtype=np.uint64)
    return out.view(np.int64)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id``, ``digest`` (of the text) and ``fp`` (the fingerprint as a signed long) of every row; null or wordless
    texts: 0."""

    def work(cols: dict) -> dict:
        hashes = [shingle_hashes(t, words) for t in cols["text"]]
        counts = np.array([len(h) for h in hashes], np.int64)
        flat = np.fromiter(itertools.chain.from_iterable(hashes), np.uint64, counts.sum())
        return {"doc_id": cols["doc_id"], "digest": cols["digest"], "fp": majority_bits(flat, counts).tolist()}

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"), "text"), work, "doc_id long, digest long, fp long")


def _keys(prints: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            all_fp = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(all_fp), 4096):
                fp = np.ascontiguousarray(all_fp[start : start + 4096])
                key, row, probe = key_rows(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(probe)], names=["key", "fp", "probe"])

    return prints.select("fp").mapInArrow(run, "key long, fp long, probe boolean")


def refined_rows(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of key_rows with the indices near the third segment, and the position of the row that each is of."""
    unsigned = prints.view(np.uint64)
    tables = list(itertools.permutations(range(3), 2))
    third = np.array([3 - i - j for i, j in tables])[keys >> 36]
    words = np.zeros(len(keys), np.int64)
    for k, (shift, width) in enumerate(SEGMENTS):
        mine = third == k
        words[mine] = (unsigned[mine] >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)
    near = fuzzy_indices(words)
    row, column = np.nonzero(near >= 0)
    return (keys[row] << 12) | near[row, column], row


def _refined(rows: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.slice(start, 4096)
                key, fp = (np.ascontiguousarray(part.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
                found, row = refined_rows(key, fp)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(fp[row]), part.column(2).take(pa.array(row))], names=["key", "fp", "probe"])

    return rows.select("key", "fp", "probe").mapInArrow(run, "key long, fp long, probe boolean")


def _met(keys: DataFrame, pairs_per_key: int) -> tuple[DataFrame, DataFrame]:
    """The linked pairs (a, b) that meet under keys of few, and the rows of the other keys."""
    sizes = cut(keys.groupBy("key").agg(F.count_if("probe").alias("n_probe"), F.count_if(~F.col("probe")).alias("n_filed")).where("n_filed > 0 and n_probe > 1"))
    many = F.col("n_probe") * F.col("n_filed") > pairs_per_key
    mine = keys.join(sizes.where(~many).select("key"), "key")
    pairs = (
        mine.where("not probe").select("key", F.col("fp").alias("a"))
        .join(mine.where("probe").select("key", F.col("fp").alias("b")), "key")
        .where("a < b and bit_count(a ^ b) <= 2")
        .select("a", "b")
    )
    return pairs, keys.join(sizes.where(many).select("key"), "key")


def links(prints: DataFrame, pairs_per_key: int = PAIRS_PER_KEY) -> DataFrame:
    """Edges (a, b) that join all of ``prints`` (distinct ``fp``) which are linked by chains of at most two differing bits."""
    pairs, crowd = _met(cut(_keys(prints)), pairs_per_key)
    crowd = cut(crowd)
    if crowd.isEmpty():
        return pairs.distinct()
    more, dense = _met(cut(_refined(crowd)), pairs_per_key)
    points = dense.select("fp").distinct().select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("point"))
    stars = (
        points.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    )
    return pairs.union(more).union(stars).distinct()


@releases
def near_duplicates(docs: DataFrame, words: int = 3, pairs_per_key: int = PAIRS_PER_KEY) -> DataFrame:
    """Fingerprint and component of every document.

    Returns one row per row of ``docs``: ``doc_id``, ``digest`` (of the text), ``fp`` (long), ``fingerprint`` (16
    hex digits) and ``component_id``: the smallest doc_id that chains of links at two or fewer differing bits reach, itself included.

    Null and wordless texts have fingerprint zero and link like others. Rows with equal texts, also under one doc_id,
    share a component. A null doc_id keeps its row; a component's id is null only if all of its ids are.
    Empty tables give empty results. Extra columns of any name are left out.
    """
    each = cut(fingerprints(docs, words))
    prints = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    component = connected_components(links(prints, pairs_per_key))
    root = cut(prints.join(component, prints.fp == component.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = root.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(root.join(ids, "root").select("fp", "component_id"))
    return each.join(named, "fp").select("doc_id", "digest", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@releases
def representatives(docs: DataFrame, words: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each component of near_duplicates does: that of the smallest doc_id (nulls last)."""
    # a null component_id joins those whose ids are all null, each by its fingerprint
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fingerprint")))
    return one_of_each(docs, near_duplicates(docs, words).select("doc_id", "digest", group.alias("group")))


def _nodes(docs: DataFrame, words: int) -> DataFrame:
    """Of every row ``doc_id``, ``digest``, ``node`` (hash of its shingle set), ``n`` (shingles), ``bands``, ``parity`` and ``fp``; wordless texts have
    no band."""

    def work(cols: dict) -> dict:
        sets = jaccard.shingle_sets(cols["text"], words)
        full = [s for s in sets if len(s)]
        keys = iter(jaccard.band_keys(full).tolist() if full else [])
        counts = np.array([len(s) for s in sets], np.int64)
        return {
            "doc_id": cols["doc_id"],
            "digest": cols["digest"],
            "node": np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64).tolist(),
            "n": counts.tolist(),
            "bands": [next(keys) if len(s) else [] for s in sets],
            "parity": jaccard.parities(sets),
            "fp": majority_bits(np.concatenate([*sets, np.empty(0, np.uint64)]), counts).tolist(),
        }

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"), "text")
    return map_texts(own, work, "doc_id long, digest long, node long, n long, bands array<long>, parity array<long>, fp long")


def similar(docs: DataFrame, words: int = SIMILAR_WORDS, pairs_per_bucket: int = jaccard.PAIRS_PER_BUCKET) -> DataFrame:
    """``doc_id``, ``digest`` (of the text) and ``group`` of every row; rows linked by chains of texts whose ``words``-word shingle sets have a
    similarity of 0.8 or more share a group.

    Texts of at most ``words`` words are one shingle; null and wordless ones share a group.
    """
    each = cut(_nodes(docs, words))
    row = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("row")
    nodes = cut(each.where("n > 0").groupBy("node").agg(row, *(F.first(c).alias(c) for c in ("n", "bands", "parity", "fp"))))
    edges = cut(links(nodes.select("fp").distinct()))
    ends = edges.select(F.explode(F.array("a", "b")).alias("fp"), F.xxhash64(F.lit("link"), "a", "b").alias("key"))
    keys = (
        nodes.select("node", F.explode("bands").alias("key"))
        .union(nodes.select("node", F.xxhash64(F.lit("equal"), "fp").alias("key")))
        .union(nodes.select("node", "fp").join(ends, "fp").select("node", "key"))
    )
    component = jaccard.linked(docs, nodes, keys, words, pairs_per_bucket)
    return each.join(component, "node", "left").select("doc_id", "digest", F.coalesce("root", "node").alias("group"))


@releases
def similar_representatives(docs: DataFrame, words: int = SIMILAR_WORDS, pairs_per_bucket: int = jaccard.PAIRS_PER_BUCKET) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each group of similar texts does; see ``one_of_each``."""
    return one_of_each(docs, similar(docs, words, pairs_per_bucket))


def one_of_each(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The row of the smallest doc_id (nulls last) of each group; ``named`` has ``doc_id``, ``digest`` and ``group`` of every row.

    Of rows that share this id, the one whose text has the smallest digest stays; of rows equal in both, one. All columns are
    kept.
    """
    named = cut(named)
    first = named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("first"), F.count(F.lit(1)).alias("rows"))
    crowds = cut(first.where("rows > 1").select("group", "first"))
    members = cut(named.join(crowds, "group").select("doc_id", "digest", "first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    kept = without(docs, members.where(~stays).select("doc_id", "digest"))
    again = cut(members.where(stays).groupBy("doc_id", "digest").count().where("count > 1").select("doc_id", "digest"))
    if again.isEmpty():
        return kept
    rows = packed(kept, F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"))
    single = rows.join(again.select(F.col("doc_id").alias("id"), F.col("digest").alias("name")), F.expr("doc_id <=> id and digest = name"), "left_semi")
    return without(kept, again).unionByName(single.dropDuplicates(["doc_id", "digest"]).select("row.*"))
