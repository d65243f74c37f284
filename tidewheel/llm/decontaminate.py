"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item's windows (ten consecutive words; shorter items are one window) are sets of shingles at known
offsets. A window occurs in a document only if all of its shingles do, so one of them is enough to find it: the
rarest. Shingles are ordered by how often they occur in the documents, each window is filed under the first of that
order, the documents' shingles are joined to those prefixes, length and offset bound where the window may lie,
and the words are compared.

The documents are read once. A bitmap of fixed size, made of the benchmark's shingle hashes, lets through only runs of
consecutive shingles that are long enough for some window; what it lets through by chance is dropped by the join.
"""

from __future__ import annotations

import itertools

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, cut, digest, in_bitmap, map_texts, releases

#: Letters A-Z fall to a-z; other ASCII but letters and digits separates words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WINDOW, SHINGLE = 10, 5


def positions_hashed(found: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, joined by spaces."""
    count = len(found) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    lens = list(map(len, found))
    ends = list(itertools.accumulate(lens))
    digest, last = xxhash.xxh64_intdigest, size - 1
    return np.fromiter((digest(joined[e - n + i : ends[i + last] + i + last], 42) for i, (e, n) in enumerate(zip(ends[:count], lens, strict=False))), np.uint64, count)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """``windows`` (window, m, g: one row per different window) and ``owners`` (window, item_id)."""

    def work(cols: dict) -> dict:
        out = [[w.decode() for w in t.translate(WORD_BYTES).split()] for t in cols["text"]]
        return {"item_id": cols["item_id"], "words": out}

    items = map_texts(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text"), work, "item_id string, words array<string>")
    m = f"least({window}, size(words))"
    owners = cut(
        items.where("size(words) > 0")
        .select(F.coalesce("item_id", F.lit("")).alias("item_id"), F.explode(F.expr(f"transform(sequence(1, size(words) - {m} + 1), i -> array_join(slice(words, i, {m}), ' '))")).alias("window"))
        .distinct()
    )
    windows = owners.select("window").distinct().withColumn("m", F.size(F.split("window", " "))).withColumn("g", F.least(F.lit(shingle), "m"))
    return cut(windows), owners


def _shingles(frame: DataFrame, words: str, *keep: str) -> DataFrame:
    """Each shingle of g words: its hash ``key`` and its place ``o``, from 0."""
    return frame.select(
        *keep,
        F.posexplode(F.expr(f"transform(sequence(1, size({words}) - g + 1), i -> xxhash64(array_join(slice({words}, i, g), ' ')))")).alias("o", "key"),
    )


def runs_of(hit: np.ndarray, least: int) -> list[tuple[int, int]]:
    """First and last place of each run of at least ``least`` hits."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    first, last = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0] - 1
    return [(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True) if b - a + 1 >= least]


def scan(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per document: rid, doc_id, n_words, and the runs of words in which a window may lie."""
    spark = docs.sparkSession
    # the longest shingle size is fixed, so these are a handful of numbers
    needs = [(r.g, r.least) for r in windows.groupBy("g").agg(F.min(F.expr("m - g + 1")).alias("least")).collect()]
    shingles = _shingles(windows.withColumn("words", F.split("window", " ")), "words", "window")
    mask = spark.sparkContext.broadcast(bitmap(shingles.select("key")))

    def work(cols: dict) -> dict:
        bits = np.frombuffer(mask.value, np.uint8)
        counts, runs = [], []
        for text in cols["text"]:
            found = text.translate(WORD_BYTES).split()
            mine = []
            for g, least in needs:
                hit = in_bitmap(bits, positions_hashed(found, g))
                if hit.any():
                    mine += [{"start": a, "g": g, "text": b" ".join(found[a : b + g]).decode()} for a, b in runs_of(hit, least)]
            counts.append(len(found))
            runs.append(mine)
        return {"doc_id": cols["doc_id"], "digest": cols["digest"], "n_words": counts, "runs": runs}

    found = map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"), "text"), work, "doc_id long, digest long, n_words long, runs array<struct<start:int,g:int,text:string>>")
    return cut(found.withColumn("rid", F.monotonically_increasing_id()))


@releases
def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Which words of each document lie in an occurrence of a window of a benchmark item.

    Returns one row per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items`` (the item_ids as
    strings, sorted), ``contaminated``, ``digest`` (of the text). Words: A-Z lower-cased, runs of ASCII letters, digits and characters beyond
    ASCII.

    Bytes that are no UTF-8 are read as replacement characters, on both sides. Null and wordless texts have no words and no hits; null and wordless items have no windows; an item without an id
    counts under the empty one; rows that share an id or a text are judged each for itself. An empty table on either
    side gives no hits. Extra columns are left out.
    """
    windows, owners = benchmark_windows(benchmark, window, shingle)
    each = scan(docs, windows)
    runs = each.where(F.size("runs") > 0).select("rid", F.explode("runs").alias("r")).select("rid", "r.start", "r.g", F.split("r.text", " ").alias("words"))
    pieces = _shingles(windows.withColumn("words", F.split("window", " ")), "words", "window", "m", "g")
    wanted = pieces.select("g", "key").distinct()
    seen = _shingles(runs, "words", "g").groupBy("g", "key").agg(F.count(F.lit(1)).alias("n")).join(wanted, ["g", "key"])
    prefix = cut(
        pieces.join(seen, ["g", "key"])
        .groupBy("window", "m", "g")
        .agg(F.min(F.struct("n", "key", "o")).alias("rare"), F.count(F.lit(1)).alias("present"))
        .where("present = m - g + 1")  # a shingle that no document has rules its window out
        .select("window", "m", "g", "rare.key", F.col("rare.o").alias("offset"))
    )
    met = _shingles(runs, "words", "rid", "start", "g", "words").join(prefix, ["g", "key"])
    hits = cut(
        met.where("o >= offset and o - offset + m <= size(words)")
        .where("array_join(slice(words, o - offset + 1, m), ' ') = window")
        .select("rid", (F.col("start") + F.col("o") - F.col("offset")).alias("at"), "m", "window")
        .distinct()
    )
    covered = hits.groupBy("rid").agg(
        F.expr(
            "aggregate(array_sort(collect_list(struct(at, at + m as e))), struct(0 as e, 0L as n), "
            "(a, x) -> struct(greatest(a.e, x.e) as e, a.n + greatest(0, x.e - greatest(a.e, x.at)) as n), a -> a.n)"
        ).alias("n_hit")
    )
    owned = hits.select("rid", "window").distinct().join(owners, "window").groupBy("rid").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return (
        each.select("rid", "doc_id", "digest", "n_words").join(covered.join(owned, "rid"), "rid", "left")
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), "digest")
    )
