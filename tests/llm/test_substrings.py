import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidewheel.llm import substrings


def brute(rows, window):
    words = [(r[1] or "").encode().split() for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    for row, w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        yield row[0], len(w), sum(gone), hashlib.sha256(kept).hexdigest()


COLUMNS = ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_against_brute_force(docs, rows, same):
    same(substrings.repeated_words(docs), COLUMNS, brute(rows, 35))


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_short_windows_and_crowded_keys(docs, rows, same, monkeypatch, levels):
    """Keys of over two segments are divided, by one to seven more hashes, and then window by window."""
    monkeypatch.setattr(substrings, "KEY_SEGMENTS", 2)
    monkeypatch.setattr(substrings, "SHARD_SEGMENTS", 20)
    monkeypatch.setattr(substrings, "LEVELS", levels)
    same(substrings.repeated_words(docs, window=6, gram=2), COLUMNS, brute(rows, 6))


def test_long_words_and_invalid_bytes(spark, same):
    words = [f"w{i}" for i in range(60)]
    words[7] = "x" * 100_000
    other = [*words[:7], "x" * 99_999 + "y", *words[8:]]
    long = [" ".join(words), " ".join(words), " ".join(other), " ".join(["z" * 64, *words[1:50]]), " ".join(words[40:])]
    same(substrings.repeated_words(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")), COLUMNS, brute(list(enumerate(long)), 35))
    frame = spark.sql("select id doc_id, cast(concat(unhex('FF20'), encode(repeat('a b c ', 20), 'utf-8')) as string) text from range(2)")
    fixed = "\ufffd " + "a b c " * 20
    same(substrings.repeated_words(frame), COLUMNS, brute([(0, fixed), (1, fixed)], 35))


def test_empty(nothing):
    assert substrings.repeated_words(nothing).count() == 0


def test_shard_against_counting():
    rng = random.Random(5)
    for trial in range(30):
        window = rng.randint(2, 5)
        texts = list({" ".join(rng.choice("abc") for _ in range(rng.randint(window, 14))) for _ in range(rng.randint(1, 12))})
        copies = np.array([rng.choice([1, 1, 1, 3]) for _ in texts])
        seen = Counter()
        for t, n in zip(texts, copies, strict=True):
            w = t.split(" ")
            for i in range(len(w) - window + 1):
                seen[tuple(w[i : i + window])] += int(n)
        expected = [[i for i in range(len(t.split(" ")) - window + 1) if seen[tuple(t.split(" ")[i : i + window])] > 1] for t in texts]
        assert substrings.judge_shard(texts, copies, window) == expected


def test_wavelet_matrix_ranks():
    symbols = np.random.default_rng(2).integers(0, 37, 500)
    tree = substrings.WaveletMatrix(symbols, 6)
    every = np.arange(37)
    zero = tree.down(every, np.zeros(37, np.int64))
    for at in (0, 1, 63, 64, 65, 250, 500):
        counts = tree.down(every, np.full(37, at)) - zero
        assert counts.tolist() == np.bincount(symbols[:at], minlength=37).tolist()


def test_word_hashes():
    words = [b"a", b"b", b"ab", b"ba", b"a", b"\0", b"\0\0", b"x" * 3_000_000, b"x" * 2_999_999 + b"y", "é".encode(), b"ab"]
    found = substrings.word_hashes(words)
    assert len(set(found.tolist())) == 9 and found[0] == found[4] and found[2] == found[10]
    assert (substrings.word_hashes(words[::-1])[::-1] == found).all() and substrings.word_hashes([b"ba"])[0] == found[3]


def test_equal_windows_share_their_minimizer():
    rng = random.Random(1)
    shared = [f"s{i}".encode() for i in range(80)]
    keys = []
    documents = [[str(rng.random()).encode() for _ in range(50)] + shared + [str(rng.random()).encode() for _ in range(50)] for _ in range(2)]
    documents[1:1] = [[], [b"few", b"words"], shared[:35], shared[:34]]
    who, key, first, last = substrings.segments(documents, 35, 8)
    for d, words in enumerate(documents):
        by_start = {s: k for w, k, a, b in zip(who.tolist(), key.tolist(), first.tolist(), last.tolist(), strict=True) if w == d for s in range(a, b + 1)}
        assert sorted(by_start) == list(range(len(words) - 34))
        if len(words) > 100:
            keys.append([by_start[s] for s in range(50, 50 + 80 - 34)])
    assert keys[0] == keys[1]
    assert substrings.segments([[]], 35, 8)[0].tolist() == []
