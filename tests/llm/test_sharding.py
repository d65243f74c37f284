import hashlib
from collections import Counter

import pytest

from tidewheel.llm import sharding


def brute(shards, size):
    """Each shard's whole preference list, and turns over them."""
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    lists = []
    for s in shards:
        offset, step = number(f"offset:{s}") % size, number(f"step:{s}") % (size - 1) + 1
        lists.append([(offset + j * step) % size for j in range(size)])
    table, nexts = {}, [0] * len(shards)
    while len(table) < size:
        for k, wanted in enumerate(lists):
            if len(table) == size:
                break
            while wanted[nexts[k]] in table:
                nexts[k] += 1
            table[wanted[nexts[k]]] = k
    return [table[i] for i in range(size)]


@pytest.mark.parametrize("n,size", [(1, 7), (3, 13), (13, 13), (10, 997)])
def test_table_against_brute_force(n, size):
    shards = [f"s{i}" for i in range(n)]
    table = sharding.lookup_table(shards, size)
    assert table == brute(shards, size)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_few_slots_move():
    a = sharding.lookup_table([f"s{i}" for i in range(20)], 4001)
    b = sharding.lookup_table([f"s{i}" for i in range(19)], 4001)
    assert sum(x != y for x, y in zip(a, b, strict=True) if x < 19) < 0.15 * 4001


def test_bad_tables():
    for shards, size in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, size)


def test_place(docs, rows, nothing, same):
    shards, size = [f"s{i}" for i in range(5)], 101
    table = brute(shards, size)
    got = sharding.place(docs, shards, size=size)
    assert got.columns == [*docs.columns, "slot"] or set(got.columns) == {*docs.columns, "slot"}
    slot = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16) % size
    same(got, ["doc_id", "slot", "shard"], [(r[0], slot(r[0]), table[slot(r[0])]) for r in rows])
    assert sharding.place(nothing, shards, size=size).count() == 0
