import itertools
import random

import pytest

from tidewheel.llm import linededup


def brute(rows, least, words):
    """The windows of ``least`` lines, and the lines of ``words`` words, that also occur earlier."""
    documents = {(r[0], r[1]): None for r in rows}  # equal in both: one document
    order = sorted((d for d in documents if d[1] is not None), key=lambda d: (d[0] is not None, d[0] or 0))
    first, out = set(), {}
    ties = [k for k, g in itertools.groupby(order, key=lambda d: d[0]) if len(list(g)) > 1]
    for d in order:
        lines = d[1].split("\n")
        places = [i for i, x in enumerate(lines) if x.replace(" ", "") != ""]
        gone = set()
        for k in range(len(places)):
            for size in {1, least}:
                at = places[k : k + size]
                run = tuple(lines[p] for p in at)
                if len(run) == size and (size == least or len(run[0].encode().split()) >= words):
                    if run in first:
                        gone.update(at)
                    first.add(run)
        out[d] = (d[0], "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return [out.get((r[0], r[1]), (r[0], None, 0, 0)) for r in rows], ties


@pytest.mark.parametrize("least,words", [(1, 50), (2, 50), (2, 25), (3, 20)])
def test_against_brute_force(docs, rows, same, least, words):
    expected, ties = brute(rows, least, words)
    got = linededup.dedup_lines(docs.drop("n_lines"), least, words)
    assert got.columns == [*docs.columns, "n_lines", "n_removed", "kept_text"]
    keep = [e for e in expected if e[0] not in ties]  # which of several texts under one id comes first is up to their digests
    tied = [t for t in ties if t is not None]
    untied = got.where(got.doc_id.isNull() | ~got.doc_id.isin(tied))
    if None in ties:
        untied = untied.where("doc_id is not null")
    same(untied, ["doc_id", "kept_text", "n_lines", "n_removed"], keep)
    assert got.count() == len(rows)


def longest(rows, least):
    """By document the maximal runs that also begin earlier: (place, lines), each with the longest earlier match."""
    texts, out = sorted((r for r in rows if r[1]), key=lambda r: r[0]), {}
    places = [(d, i) for d, r in enumerate(texts) for i in range(len(r[1].split("\n")))]
    lines = [r[1].split("\n") for r in texts]
    match = lambda a, b: sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(lines[a[0]][a[1] :], lines[b[0]][b[1] :], strict=False)))
    for at, (d, i) in enumerate(places):
        out[texts[d][0], i] = max((match((d, i), t) for t in places[:at]), default=0)
    return {k: n for k, n in out.items() if n >= least}


@pytest.mark.parametrize("least", [2, 3, 5])
def test_runs_of_all_lengths(spark, least):
    """Runs of 1 to 20 lines, within and across documents: what they cover is what any earlier match covers, and each is as long as it can be."""
    rng = random.Random(least)
    pool = [f"line {i}" for i in range(6)]
    blocks = [[rng.choice(pool) + rng.choice("ab") for _ in range(n)] for n in range(1, 21)]
    rows = []
    for d in range(24):
        parts = [rng.choice(blocks) for _ in range(rng.randint(1, 4))] + [[f"own {d} {k}" for k in range(rng.randint(0, 3))]]
        rng.shuffle(parts)
        rows.append((d, "\n".join(x for p in parts for x in p)))
    rows.append((50, rows[3][1]))  # an exact copy
    found = linededup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()
    best = longest(rows, least)
    runs = {(r.doc_id, x.i): (x.run, x.first) for r in found for x in r.runs}
    cover = lambda pairs: {(d, k) for (d, i), n in pairs for k in range(i, i + n)}
    assert cover(best.items()) == cover((k, n) for k, (n, _) in runs.items())
    text = {d: t.split("\n") for d, t in rows}
    for (d, i), (n, first) in runs.items():
        a, b = text[d][i:], text[first.doc_id][first.i :]
        assert (first.doc_id, first.i) < (d, i) and a[:n] == b[:n] and a[n : n + 1] != b[n : n + 1] or len(a) == n or len(b) == n
        assert n >= least
    assert max(n for n, _ in runs.values()) >= 20


def test_rounds_follow_the_longest_repeat(spark):
    docs = spark.createDataFrame([(d, "\n".join(f"{x}" for x in range(37))) for d in range(3)] + [(9, "\n".join(f"z{x}" for x in range(500)))], "doc_id long, text string")
    assert sorted(linededup.suffix_ranks(docs, 2, 50)) == [1, 2, 4, 8, 16, 32]
    assert sorted(linededup.suffix_ranks(docs, 5, 50)) == [1, 2, 4, 5, 8, 16, 32]


def test_clashing_names(spark, same):
    names = ["row", "runs", "lines", "gone", "kept", "id", "name", "digest", "maybe", "__maybe", "i", "rank"]
    docs = spark.createDataFrame([(d, "a\nb\nc", *range(len(names))) for d in range(2)], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    got = linededup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed", "kept_text"]
    same(got, ["doc_id", "kept_text", *names], [(0, "a\nb\nc", *range(len(names))), (1, "", *range(len(names)))])


def test_empty(nothing):
    assert linededup.dedup_lines(nothing).count() == 0


def test_overlapping_run(spark):
    docs = spark.createDataFrame([(1, "a\na\na\na"), (2, "x\na\na\ny"), (3, "x\na\n\na\nz")], "doc_id long, text string")
    assert {r.doc_id: r.kept_text for r in linededup.dedup_lines(docs).collect()} == {1: "a", 2: "x\na\na\ny".replace("a\na\n", ""), 3: "\nz"}
