import hashlib

import pytest
from pyspark.sql import functions as F

from tidewheel.llm import mixing


def share_out(budget, children):
    """Iterative water-filling: {name: (capacity, weight)} to {name: share}."""
    open_, out, left = dict(children), {}, budget
    while open_:
        total = sum(w for _, w in open_.values())
        full = {n: c for n, (c, w) in open_.items() if c * total <= left * w}
        if not full:
            for n, (_, w) in open_.items():
                out[n] = left * w // total
            break
        for n, c in full.items():
            out[n] = c
            left -= c
            del open_[n]
    return out


def brute(rows, weights, ratio, epochs, seed, domain=lambda r: "d" + str(len(r[3] or "") % 2)):
    docs = [(domain(r), r[2] or "", r[3] or "", r[0], len((r[1] or "").encode().split())) for r in rows]
    tokens = {}
    for d, lang, s, _, n in docs:
        tokens[d, lang, s] = tokens.get((d, lang, s), 0) + n
    leaves = {p: n * epochs for p, n in tokens.items() if n and all(weights.get(p[:k], 1) for k in (1, 2, 3))}
    shares = {}

    def flow(path, budget):
        depth = len(path)
        if depth == 3:
            shares[path] = budget
            return
        children = {}
        for p, c in leaves.items():
            if p[:depth] == path:
                old = children.get(p[: depth + 1], (0, 0))[0]
                children[p[: depth + 1]] = (old + c, weights.get(p[: depth + 1], 1))
        for child, b in share_out(budget, children).items():
            flow(child, b)

    flow((), int(sum(tokens.values()) * ratio))
    key = lambda e, i: int(hashlib.md5(f"{seed}:{e}:{'' if i is None else i}".encode()).hexdigest()[:15], 16)
    out = []
    for p, share in shares.items():
        mine = [x for x in docs if x[:3] == p]
        full, rest = divmod(share, tokens[p])
        out += [(p[0], e, x[4], x[3]) for e in range(full) for x in mine]
        if rest:
            keyed = sorted((key(full, x[3]), x[4], x[3]) for x in mine if True) if all(x[3] is not None for x in mine) else sorted(((key(full, x[3]), x[4], x[3]) for x in mine), key=lambda t: t[0])
            for k, n, i in keyed:
                if sum(m for k2, m, _ in keyed if k2 <= k) <= rest:
                    out.append((p[0], full, n, i))
    return out


@pytest.mark.parametrize("ratio,epochs", [(0.3, 1), (0.8, 3), (5.0, 2)])
def test_against_brute_force(docs, rows, same, ratio, epochs):
    weights = {("d0",): 3, ("d1", "en"): 5, ("d1", "fr"): 2, ("d0", "en", "src1"): 0}
    domain = F.concat(F.lit("d"), F.length(F.coalesce("source", F.lit(""))) % 2)
    got = mixing.mix(docs, weights, ratio, epochs, 9, domain)
    assert got.columns == ["__domain", "__epoch", "__tokens", *docs.columns]
    same(got, ["__domain", "__epoch", "__tokens", "doc_id"], brute(rows, weights, ratio, epochs, 9))


def test_empty(nothing):
    assert mixing.mix(nothing, {}, domain=F.lit("d")).count() == 0


def test_shortage_stays_among_siblings(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000)], "domain string, lang string, capacity long")
    got = {(r.domain, r.lang): r.share for r in mixing.budgets(leaves, ("domain", "lang"), {}, 200).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 90, ("b", "x"): 100}
