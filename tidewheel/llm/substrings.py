"""Repeated substrings: words that lie in a window of 35 words which starts anywhere else, too.

Equal windows share their minimizer: the least hash of their grams of 8 words. Windows in a row with the minimizer
at the same place form a segment, and segments are dealt into shards by the minimizer's hash. So all occurrences
of a window are in one shard, and each shard is judged alone. Segments whose minimizer occurs once hold no repeated
window; a bitmap of fixed size keeps them out of the shuffle.

Each shard builds a compressed FM-index over its different segments: the Burrows-Wheeler transform of their words in a
wavelet matrix of packed bits. Its segments are streamed against it by backward search. From a segment's end, the match is
extended to the left while it occurs more than once, copies of segments counted; that gives the longest match that ends
there. Of length 35 or more, all windows in it are repeated. The search goes on from the next end that can
still matter.

A minimizer with more than KEY_SEGMENTS different segments is divided: its windows get a second minimizer by another hash, a third where that
isn't enough, and so on, and are dealt anew by all of them. Equal windows still agree in each, so they stay together. After LEVELS hashes the
window's whole text is the key.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, bitmap_pieces, cut, digest, in_bitmap, map_texts, possible, releases, slices, valid

WINDOW, GRAM = 35, 8
#: Bits of the bitmap of repeated minimizers: 16 MB, whatever the corpus' size.
MINIMIZER_BITS = 1 << 27
#: Different segments in a shard, about, and of one key, about, before it is divided.
SHARD_SEGMENTS, KEY_SEGMENTS = 8_192, 16_384
#: Hashes by which a key's windows are divided.
LEVELS = 8
#: Longest word in bytes that segments hold; of a longer one they hold a digest, which is longer than any word that stays.
LONGEST_WORD = 64


#: Base of the words' hashes, which is odd, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A number for each word, by its bytes alone: differences of running sums of byte times power, turned back to the word's start. Different
    words may share one, which costs work and no result."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    text = np.frombuffer(b" ".join(words), np.uint8)
    size = 1 << max(20, len(text).bit_length())
    end = np.cumsum(lens + 1) - 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, size)[: len(text)])))
    return (sums[end] - sums[end - lens]) * _powers(_INVERSE, size)[end - lens]


def segments(documents: list[list[bytes]], window: int, gram: int, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of several documents' words: document, minimizer, first and last window start in the document.

    All documents go through one pass over their joined words; windows across a border are left out. Each ``level`` has a hash of its own.
    """
    sizes = np.fromiter(map(len, documents), np.int64, len(documents))
    total = int(sizes.sum())
    n = total - window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none.view(np.uint64), none, none
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h = word_hashes(list(itertools.chain.from_iterable(documents)))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
        g = np.zeros(total - gram + 1, np.uint64)
        for j in range(gram):
            g = g * base + h[j : j + len(g)]
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            g = (g ^ (g >> np.uint64(shift))) * np.uint64(factor)
        g ^= g >> np.uint64(29)
        if level:
            g = (g ^ np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            g ^= g >> np.uint64(32)
    # place of the leftmost least gram in every stretch of a window's grams
    at, width, grams = np.arange(len(g)), 1, window - gram + 1
    while 2 * width <= grams:
        left, right = at[: len(at) - width], at[width:]
        at, width = np.where(g[left] <= g[right], left, right), 2 * width
    left, right = at[:n], at[grams - width : grams - width + n]
    at = np.where(g[left] <= g[right], left, right)
    owner = np.repeat(np.arange(len(documents)), sizes)
    inside = owner[:n] == owner[window - 1 :]
    edge = np.nonzero((np.diff(at) != 0) | (np.diff(owner[:n]) != 0) | (inside[1:] != inside[:-1]))[0] + 1
    first = np.concatenate(([0], edge))
    last = np.concatenate((edge - 1, [n - 1]))
    first, last = first[inside[first]], last[inside[first]]
    who = owner[first]
    zero = (np.cumsum(sizes) - sizes)[who]
    return who, g[at[first]], first - zero, last - zero


class WaveletMatrix:
    """Symbols by their bits, highest first, each level stably parted by its bit; bits packed with counts every 64."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.size, self.levels = len(symbols), []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            packed = np.packbits(np.concatenate((bit, np.zeros(-len(bit) % 64 + 64, bool))), bitorder="little").view(np.uint64)
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))[:-1].astype(np.int32)
            zeros = len(bit) - int(bit.sum())
            self.levels.append((level, packed, counts, zeros))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    def down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` falls in the last level, among the symbols equal to ``symbols``."""
        for level, packed, counts, zeros in self.levels:
            block = at >> 6
            ones = counts[block] + np.bitwise_count(packed[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbols >> level & 1, zeros + ones, at - ones)
        return at


class FmIndex:
    """FM-index of sequences (arrays of symbols from 1) with weights."""

    def __init__(self, text: np.ndarray, ends: np.ndarray, weights: np.ndarray):
        """``text``: the sequences one after the other, a 0 after each; ``ends``: the places of the zeros."""
        n = len(text)
        self.text = text
        # zeros count as different, so that all suffixes differ within the longest sequence
        rank = text + len(ends)
        rank[ends] = np.arange(len(ends))
        step = 1
        while True:
            second = np.zeros(n, np.int64)
            second[: n - step] = rank[step:] + 1
            key = rank * (n + len(ends) + int(text.max(initial=0)) + 2) + second
            order = np.argsort(key)
            new = np.empty(n, np.int64)
            new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            rank, step = new, 2 * step
            if n == 0 or rank[order[-1]] == n - 1:
                break
        before = text[order - 1]  # the first suffix is preceded by the last zero
        owner = np.searchsorted(ends, order)
        self.upto = np.concatenate(([0], np.cumsum(weights[owner])))
        sigma = int(text.max(initial=0)) + 1
        self.tree = WaveletMatrix(before, max(1, (sigma - 1).bit_length()))
        smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))[:-1]
        every = np.arange(sigma)
        self.shift = smaller - self.tree.down(every, np.zeros(sigma, np.int64))

    def extend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that start with each symbol followed by what [lo, hi) start with."""
        shift = self.shift[symbols]
        return shift + self.tree.down(symbols, lo), shift + self.tree.down(symbols, hi)

    def weight(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.upto[hi] - self.upto[lo]


def repeated_starts(index: FmIndex, first: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stream the sequences text[first:end] against the index.

    Returns (sequence, start, stop): windows that begin at text places from start to stop - 1 occur more than once.
    """
    found = []
    who = np.arange(len(first))
    last, left = end.copy(), end.copy()  # where the match ends, and where it begins
    lo, hi = np.zeros(len(first), np.int64), np.full(len(first), len(index.text), np.int64)
    while len(who):
        room = left > first
        new_lo, new_hi = index.extend(index.text[np.maximum(left - 1, 0)], lo, hi)
        grows = room & (index.weight(new_lo, new_hi) >= 2)
        # matches that end here: report them, and go on with the next end that can still matter
        stop = ~grows
        if stop.any():
            s_who, s_left, s_last = who[stop], left[stop], last[stop]
            long = s_last - s_left >= window
            if long.any():
                found.append((s_who[long], s_left[long], s_last[long] - window + 1))
            last[stop] = np.where(long, s_left + window - 1, s_last - 1)
            last[stop] = np.where(room[stop], last[stop], 0)
        left = np.where(grows, left - 1, last)
        lo, hi = np.where(grows, new_lo, 0), np.where(grows, new_hi, len(index.text))
        alive = last - first >= window
        who, first, last, left, lo, hi = who[alive], first[alive], last[alive], left[alive], lo[alive], hi[alive]
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def judge_shard(texts: list[str], copies: np.ndarray, window: int) -> list[list[int]]:
    """Per different segment the starts of its windows that occur more than once in the shard."""
    ids: dict[str, int] = {}
    numbers = [[ids.setdefault(w, len(ids) + 1) for w in t.split(" ")] for t in texts]
    lens = np.array([len(x) for x in numbers], np.int64)
    end = np.cumsum(lens + 1) - 1
    text = np.zeros(int((lens + 1).sum()), np.int64)
    for x, e in zip(numbers, end.tolist(), strict=True):
        text[e - len(x) : e] = x
    out: list[list[int]] = [[] for _ in texts]
    for i in np.nonzero(copies > 1)[0].tolist():
        out[i] = list(range(int(lens[i]) - window + 1))
    ask = np.nonzero(copies == 1)[0]
    who, start, stop = repeated_starts(FmIndex(text, end, copies), (end - lens)[ask], end[ask], window)
    for i, a, b in zip(ask[who].tolist(), start.tolist(), stop.tolist(), strict=True):
        zero = int(end[i] - lens[i])
        out[i] += range(a - zero, b - zero)
    return [sorted(set(x)) for x in out]


def _short(word: bytes) -> bytes:
    return word if len(word) <= LONGEST_WORD else b"\x1f" + hashlib.sha256(word).hexdigest().encode()


def _divided(found: DataFrame, window: int, gram: int, level: int) -> DataFrame:
    """Segments cut further, by the minimizers of a level; of the last one into single windows, each a key of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in slices(batches, "words"):
            documents = [w.split(b" ") for w in cols["words"]]
            if level < LEVELS:
                who, keys, first, last = segments(documents, window, gram, level)
                parts = zip(who.tolist(), keys.tolist(), first.tolist(), last.tolist(), strict=True)
            else:
                parts = ((d, None, i, i) for d, words in enumerate(documents) for i in range(len(words) - window + 1))
            out: dict[str, list] = {"doc_id": [], "digest": [], "key": [], "start": [], "words": []}
            for d, k, a, b in parts:
                words = b" ".join(documents[d][a : b + window])
                both = xxhash.xxh64_intdigest(cols["key"][d].to_bytes(8, "little", signed=True) + (words if k is None else k.to_bytes(8, "little")), level)
                for name, value in (("doc_id", cols["doc_id"][d]), ("digest", cols["digest"][d]), ("key", both - (1 << 64) if both >> 63 else both), ("start", cols["start"][d] + a), ("words", words.decode())):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["digest"], pa.int64()), pa.array(out["key"], pa.int64()), pa.array(out["start"], pa.int32()), pa.array(out["words"])], names=list(out))

    return found.mapInArrow(run, "doc_id long, digest long, key long, start int, words string")


def _dealt(found: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments (doc_id, digest, key, start, words) so divided that no key has many different ones; the different ones (key, words, n); and per
    key their number ``m`` and the ``most`` copies of one.

    Keys are told apart by a bitmap of fixed size, so no text is shuffled; a key that it takes for a crowded one is divided, too.
    """
    out = []
    for level in range(LEVELS + 1):
        different = cut(found.groupBy("key", "words").agg(F.count(F.lit(1)).alias("n")))
        keys = cut(different.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("most")))
        crowded = keys.where(F.col("m") > KEY_SEGMENTS).select("key")
        if level == LEVELS or crowded.isEmpty():
            out.append((found, different, keys))
            break
        pieces = cut(bitmap_pieces(crowded))
        apart = lambda df, pieces=pieces: [possible(df, F.col("key"), pieces).where(f"{no} __maybe").drop("__maybe") for no in ("not", "")]
        stay, go = apart(found)
        out.append((stay, apart(different)[0], apart(keys)[0]))
        found = cut(_divided(go, window, gram, level + 1))
    return tuple(functools.reduce(DataFrame.unionByName, parts) for parts in zip(*out, strict=True))


def _count_minimizers(texts: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in slices(batches, "text"):
            keys = segments([t.split() for t in cols["text"]], window, gram)[1]
            found, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    return texts.mapInArrow(run, "key long, n long")


def _scan(docs: DataFrame, repeated: bytes, window: int, gram: int) -> DataFrame:
    """Per document its name, n_words, the hash of all its words, and its segments with repeated minimizers."""
    mask = docs.sparkSession.sparkContext.broadcast(repeated)
    kind = pa.list_(pa.struct([("key", pa.int64()), ("start", pa.int32()), ("words", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(mask.value, np.uint8)
        for cols in slices(batches, "text"):
            documents = [t.split() for t in cols["text"]]
            who, keys, first, last = segments(documents, window, gram)
            at = np.nonzero(in_bitmap(bits, keys))[0]
            held = [list(map(_short, x)) if x and max(map(len, x)) > LONGEST_WORD else x for x in documents]
            found: list[list[dict]] = [[] for _ in documents]
            for d, k, a, b in zip(who[at].tolist(), keys[at].view(np.int64).tolist(), first[at].tolist(), last[at].tolist(), strict=True):
                found[d].append({"key": k, "start": a, "words": b" ".join(held[d][a : b + window]).decode()})
            counts = list(map(len, documents))
            whole = [hashlib.sha256(b" ".join(words)).hexdigest() for words in documents]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols["doc_id"], pa.int64()), pa.array(cols["digest"], pa.int64()), pa.array(counts, pa.int64()), pa.array(whole), pa.array(found, kind)],
                names=["doc_id", "digest", "n_words", "kept_sha256", "segments"],
            )

    return docs.mapInArrow(run, "doc_id long, digest long, n_words long, kept_sha256 string, segments array<struct<key:long,start:int,words:string>>")


def _judge(different: DataFrame, keys: DataFrame, window: int) -> DataFrame:
    """``different`` (key, words, n) with ``starts`` (array), where it isn't empty, by the shards' FM-indexes."""
    # a key with one segment that occurs once has no repeated window
    worth = cut(keys.where("m > 1 or most > 1"))
    total = worth.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // SHARD_SEGMENTS)))).cast("int")

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        alone = (pdf.m == 1).to_numpy()
        # all copies of one segment: nothing to search
        starts = [list(range(w.count(" ") + 2 - window)) if a else [] for w, a in zip(pdf.words, alone, strict=True)]
        rest = pdf[~alone]
        if len(rest):
            for i, found in zip(np.nonzero(~alone)[0].tolist(), judge_shard(rest.words.tolist(), rest.n.to_numpy(np.int64), window), strict=True):
                starts[i] = found
        return pd.DataFrame({"key": pdf.key, "words": pdf.words, "starts": starts})[[len(x) > 0 for x in starts]]

    return different.join(worth.select("key", "m"), "key").withColumn("shard", shard).groupBy("shard").applyInPandas(judge, "key long, words string, starts array<int>")


@releases
def repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Which words of each document lie in a window of ``window`` words that occurs elsewhere, the same document included.

    Returns one row per row of ``docs``: ``doc_id``, ``digest`` (of the text), ``n_words``, ``n_removed``, ``kept_sha256`` (of the other
    words, joined by one space). Words: `[^\\x20\\x09-\\x0D]+`, unchanged.

    Null and empty texts, and those with fewer words than a window, lose nothing. Bytes that are no UTF-8 are read as replacement characters. Rows with equal texts repeat each other, under
    one id or two, and lose every word that a window covers. Empty tables give empty results. Extra columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"), valid().alias("text"))
    counts = _count_minimizers(rows.select("text"), window, gram).groupBy("key").agg(F.sum("n").alias("n"))
    each = cut(_scan(rows, bitmap(counts.where("n > 1").select("key"), MINIMIZER_BITS), window, gram))
    found = each.select("doc_id", "digest", F.explode("segments").alias("s")).select("doc_id", "digest", "s.key", "s.start", "s.words")
    found, different, keys = _dealt(found, window, gram)
    judged = cut(_judge(different, keys, window).select("key", F.xxhash64("words").alias("words_digest"), "starts"))
    hits = (
        found.select("doc_id", "digest", "key", "start", F.xxhash64("words").alias("words_digest"))
        .join(judged, ["key", "words_digest"])
        .groupBy("doc_id", "digest")
        .agg(F.collect_set(F.struct("start", "starts")).alias("hits"))
    )
    hits = cut(hits.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.flatten(F.transform("hits", lambda h: F.transform(h["starts"], lambda s: s + h["start"]))).alias("starts")))
    mask = docs.sparkSession.sparkContext.broadcast(bitmap(hits.select(F.xxhash64("__id", "__digest").alias("key"))))

    @F.pandas_udf("boolean")
    def maybe(names):
        return pd.Series(in_bitmap(np.frombuffer(mask.value, np.uint8), names.to_numpy(np.int64).view(np.uint64)))

    def work(cols: dict) -> dict:
        removed, sha = [], []
        for text, starts in zip(cols["text"], cols["starts"], strict=True):
            words = text.split()
            edge = np.zeros(len(words) + 1, np.int64)
            at = np.unique(np.array(starts, np.int64))
            edge[at] += 1
            edge[at + window] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            removed.append(int(gone.sum()))
            sha.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)).hexdigest())
        return {"__id": cols["__id"], "__digest": cols["__digest"], "n_removed": removed, "sha": sha}

    touched = rows.where(maybe(F.xxhash64("doc_id", "digest"))).join(hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")))
    cuts = map_texts(touched.select("__id", "__digest", "text", "starts"), work, "__id long, __digest long, n_removed long, sha string")
    cuts = cuts.groupBy("__id", "__digest").agg(F.first("n_removed").alias("n_removed"), F.first("sha").alias("sha"))  # rows equal in both are equal here
    return each.join(cuts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left").select(
        "doc_id", "digest", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("sha", "kept_sha256").alias("kept_sha256")
    )
