"""Mixing sources to target weights: hierarchical token budgets, and token-prefixes of seeded epochs.

Documents are leaves' rows of a tree (by default domain, language, source). A budget of tokens flows down the tree.
Among siblings it follows their weights; what a sibling's whole subtree can't supply goes to its siblings, and
only what all of them can't supply is missing above. With capacities c and weights w that is the level l with
sum(min(c, l * w)) = budget, and each child gets min(c, l * w). Ordered by c / w, the level is the
largest of (budget - capacity of the earlier ones) / (weight of this and the later ones), so a window
per parent finds it; nothing is iterated and nothing reaches the driver but the corpus' token count.

A leaf repeats its documents for whole epochs while its budget lasts; in the last one it takes the prefix that fits, in
that epoch's seeded order. The prefix's end is found by sums over 256 ranges of the order's key, over the 256 parts of
the one where the budget ends, and then within that part, so a leaf with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, md5_long, packed, releases

LEVELS = ("domain", "lang", "source")
RANGE_BITS, STEP_BITS = 16, 8
KEY_BITS = 60


def count_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Where a document comes in an epoch: 60 bits of an MD5, which any engine computes alike."""
    return md5_long(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def fill(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Share out each parent's ``budget`` among its children (capacity, weight): adds ``share``, in whole tokens."""
    ahead = W.partitionBy(*parents).orderBy(F.col("capacity") / F.col("weight"), name)
    family = W.partitionBy(*parents)
    return (
        nodes.withColumn("before", F.sum("capacity").over(ahead) - F.col("capacity"))
        .withColumn("left", F.sum("weight").over(family) - F.sum("weight").over(ahead) + F.col("weight"))
        .withColumn("level", F.max((F.col("budget") - F.col("before")) / F.col("left")).over(family))
        .withColumn("share", F.greatest(F.lit(0), F.least(F.col("capacity"), F.floor(F.col("level") * F.col("weight")))).cast("long"))
        .drop("before", "left", "level")
    )


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple, int], budget: int) -> DataFrame:
    """``leaves`` (levels and ``capacity``) with their ``share`` of ``budget``.

    ``weights`` maps paths (tuples of the first levels' names) to whole numbers; paths that are not in it weigh 1, those
    that weigh 0 get nothing.
    """
    spark = leaves.sparkSession
    for k in range(len(levels)):
        path = F.to_json(F.array(*levels[: k + 1]))
        leaves = leaves.withColumn(f"weight_{k}", F.lit(1).cast("long"))
        mine = [(_json(p), int(w)) for p, w in weights.items() if len(p) == k + 1]
        if mine:
            given = spark.createDataFrame(mine, "path string, given long")
            leaves = leaves.join(given, path == F.col("path"), "left").withColumn(f"weight_{k}", F.coalesce("given", f"weight_{k}")).drop("path", "given")
        leaves = leaves.where(F.col(f"weight_{k}") > 0)
    leaves = cut(leaves.where("capacity > 0"))
    above = None
    for k in range(len(levels)):
        names = list(levels[: k + 1])
        nodes = leaves.groupBy(*names).agg(F.sum("capacity").alias("capacity"), F.max(f"weight_{k}").alias("weight"))
        nodes = nodes.withColumn("budget", F.lit(int(budget)).cast("long")) if above is None else nodes.join(above, names[:-1])
        shared = fill(nodes, names[:-1], names[-1])
        above = shared.select(*names, F.col("share").alias("budget"))
    return above.withColumnRenamed("budget", "share")


def _json(path: tuple) -> str:
    import json

    return json.dumps([str(p) for p in path], separators=(",", ":"), ensure_ascii=False)


def plan(docs: DataFrame, weights: Mapping[tuple, int], ratio: float, epochs: int, seed: int, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Per leaf that gets anything: levels, ``full`` (whole epochs) and ``last_key`` (where the next epoch's prefix ends; -1:
    it is empty). ``docs`` has the levels (no nulls), doc_id and n_tokens."""
    leaves = cut(docs.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shares = budgets(leaves.withColumn("capacity", F.col("tokens") * epochs), levels, weights, int(total * ratio))
    goals = cut(
        leaves.join(shares, list(levels))
        .withColumn("full", F.expr("share div tokens"))
        .select(*levels, "full", (F.col("share") - F.col("full") * F.col("tokens")).alias("rest"))
    )
    keyed = docs.join(goals.where("rest > 0"), list(levels)).select(*levels, "n_tokens", order_key(seed, F.col("full"), F.col("doc_id")).alias("key"))
    # in which range of the key the budget ends, and what is left of it there: first among 256, then among the 256 parts of that one
    edge = goals.where("rest > 0").select(*levels, F.lit(0).cast("long").alias("edge"), F.col("rest").alias("room"))
    upto = W.partitionBy(*levels).orderBy("range")
    for bits in range(0, RANGE_BITS, STEP_BITS):
        inside = keyed.join(edge, list(levels)).where(F.shiftright("key", KEY_BITS - bits) == F.col("edge"))
        ranges = inside.groupBy(*levels, "room", F.shiftright("key", KEY_BITS - bits - STEP_BITS).alias("range")).agg(F.sum("n_tokens").alias("tokens"))
        edge = cut(
            ranges.withColumn("before", F.sum("tokens").over(upto) - F.col("tokens"))
            .where("before <= room and before + tokens > room")
            .select(*levels, F.col("range").alias("edge"), (F.col("room") - F.col("before")).alias("room"))
        )
    inside = keyed.join(edge, list(levels)).where(F.shiftright("key", KEY_BITS - RANGE_BITS) == F.col("edge"))
    along = W.partitionBy(*levels).orderBy("key").rangeBetween(W.unboundedPreceding, 0)
    ends = (
        inside.withColumn("sum", F.sum("n_tokens").over(along))
        .groupBy(*levels)
        .agg(F.max(F.when(F.col("sum") <= F.col("room"), F.col("key"))).alias("key"), F.first("edge").alias("edge"))
        .select(*levels, F.coalesce("key", F.shiftleft("edge", KEY_BITS - RANGE_BITS) - 1).alias("last_key"))
    )
    return cut(goals.join(ends, list(levels), "left").select(*levels, "full", F.coalesce("last_key", F.lit(-1)).alias("last_key")))


@releases
def mix(docs: DataFrame, weights: Mapping[tuple, int], ratio: float = 0.5, epochs: int = 2, seed: int = 17, domain: Column | None = None, levels: Sequence[str] = LEVELS) -> DataFrame:
    """The rows of ``docs`` that the budgets select, one for each epoch in which a row is taken.

    ``ratio`` of the corpus' words is the budget, ``epochs`` the most times that a row can be taken. ``domain`` is the
    column of the tree's first level where docs has none of that name. Returns the columns of docs and, in front, ``__domain``,
    ``__epoch`` (from 0) and ``__tokens``, which replace columns of these names.

    A prefix ends before the first document that would exceed its leaf's budget. Rows that tie in the order's key (repeated
    ids) are taken together or not at all. Null levels form a leaf of their own, the empty name; null texts have no
    words and are taken with the prefix around them. Shares are whole tokens, rounded down at each level. Empty
    tables give empty results; extra columns are kept.
    """
    own = {"domain": domain if domain is not None else F.col("domain")} if "domain" in levels else {}
    names = [f"__{x}" for x in levels]
    keyed = [F.coalesce(own.get(x, F.col(x)).cast("string"), F.lit("")).alias(n) for x, n in zip(levels, names, strict=True)]
    counted = cut(docs.select(*keyed, F.col("doc_id").alias("doc_id"), count_words(F.col("text")).alias("n_tokens")))
    goals = plan(counted, weights, ratio, epochs, seed, names)
    marked = packed(docs, *keyed, F.col("doc_id").alias("doc_id"), "text")
    # one row a leaf: Spark broadcasts it where its files are small enough, and else shuffles
    joined = marked.join(goals, names)
    key = order_key(seed, F.col("full"), F.col("doc_id"))
    taken = F.when(key <= F.col("last_key"), F.col("full")).otherwise(F.col("full") - 1)
    made = joined.where(taken >= 0).withColumn("n_tokens", count_words(F.col("text"))).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), taken)))
    marks = {"__domain": "__domain", "epoch": "__epoch", "n_tokens": "__tokens"}
    return made.select(*(F.col(n).alias(m) for n, m in marks.items() if n in made.columns), *(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in marks.values()))
