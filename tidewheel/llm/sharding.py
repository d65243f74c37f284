"""Sharding through a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size: an offset and a step, both from a
hash of its name. The shards take turns; each claims the first free slot of its order until none is free. So all
shards have almost equally many slots, and a shard that comes or goes moves few of them. A document's slot is a hash of its
id modulo the table's size, and its shard is what the table holds there.

The table has a fixed size and goes to the executors with the plan, as a literal; placement is one look-up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import md5_long

TABLE_SIZE = 65537  # prime


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The number of the shard (its place in ``shards``) that holds each slot. ``size`` is prime and over len(shards)."""
    if not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("shards need different names, and at most one for each slot")
    if any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    at = [_number(f"offset:{s}") % size for s in shards]
    step = [_number(f"step:{s}") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
            free -= 1
            if not free:
                return table


def slot(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text, modulo the table's size; null counts as empty text."""
    return F.pmod(md5_long(F.coalesce(key.cast("string"), F.lit(""))), F.lit(size)).cast("int")


def place(docs: DataFrame, shards: Sequence[str], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (the shard's number), which replace columns of these names.

    Each row is placed by its key alone: repeated keys go to one shard, a null key goes where empty text goes. Extra columns
    are kept, empty tables stay empty. Nothing is shuffled.
    """
    table = F.from_json(F.lit(str(lookup_table(shards, size))), "array<int>")
    return docs.withColumn("slot", slot(F.col(key), size)).withColumn("shard", F.get(table, F.col("slot")))
