"""Line dedup through a suffix array over line ids.

Each document is a sequence of its non-blank lines' ids; the suffixes of all sequences are sorted by prefix doubling. A suffix's rank by k
lines is the number of suffixes before its class, those that begin with the same k lines; the rank by 2k lines orders the pairs of a
suffix's own rank by k lines and that of the suffix k lines on. It goes on until every suffix stands alone. Those that do leave at once,
since no other one begins like them, so each round works on the repeated part of the array only.

A class by k lines is an interval of the array whose longest common prefixes have at least k lines. For each suffix the longest interval in
which it isn't the first member, by document and place, says that its lines are a later copy, and of which suffix. Where that holds for
places in a row and the earlier copies are in a row as well, they are one run: it begins at the first of them, and its length is the longest
common prefix with the earlier copy, found by adding powers of two from the ranks of all rounds, the largest first. These are the maximal
repeated runs; the later copies of those that count are deleted.

Ranks come from sums over ranges of the sorted classes, so a class of any size and a line of any frequency are spread over the tasks. All of
it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bitmap_pieces, cut, digest, packed, possible, releases

#: Lines in the shortest run that counts, and words in a line that counts by itself.
MIN_LINES, MIN_WORDS = 2, 50
#: What names a suffix: its document, and its place among the non-blank lines.
PLACE = ("doc_id", "digest", "i")


def lines_of(text: str) -> str:
    return f"split({text}, '\\n', -1)"


def _blank(line: str) -> str:
    return f"replace({line}, ' ', '') = ''"


def ranked(classes: DataFrame, order: list[str]) -> DataFrame:
    """``classes`` (order columns and ``n`` members) with ``rank``: the members of all smaller classes."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(classes.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("part").agg(F.sum("n").alias("n"))
    # one row a partition
    offsets = sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("offset"))
    within = F.sum("n").over(W.partitionBy("part").orderBy(*order)) - F.col("n")
    return dealt.withColumn("within", within).join(F.broadcast(offsets), "part").select(*order, (F.col("offset") + F.col("within")).alias("rank"))


def _repeated(suffixes: DataFrame, order: list[str]) -> DataFrame:
    """The suffixes that share all of ``order`` with another one, ranked by it."""
    classes = suffixes.groupBy(*order).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cut(suffixes.join(ranked(classes, order), order).select(*PLACE, "long", "rank"))


def _joined(now: DataFrame, shift: int) -> DataFrame:
    """From ranks by k lines to ranks by k + shift (at most 2k): with the rank of the suffix ``shift`` lines on, where that is repeated, too."""
    ahead = W.partitionBy("doc_id", "digest").orderBy("i").rangeBetween(shift, shift)
    return _repeated(now.withColumn("ahead", F.max("rank").over(ahead)).where("ahead is not null").withColumnRenamed("rank", "own"), ["own", "ahead"])


def suffix_ranks(docs: DataFrame, min_lines: int, min_words: int) -> dict[int, DataFrame]:
    """By numbers of lines (powers of two until no suffix is repeated, and ``min_lines``) the repeated suffixes with their ranks: PLACE,
    ``rank``, and ``long``: whether the first line counts by itself."""
    # words are counted only in lines that are long enough to have so many
    words = f"octet_length(x) >= {2 * min_words - 1} and regexp_count(x, '[^\\\\x20\\\\x09-\\\\x0D]+') >= {min_words}"
    ids = f"transform(filter({lines_of('text')}, x -> not ({_blank('x')})), x -> struct(xxhash64(x) as h1, hash(x) as h2, {words} as long))"
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"), F.expr(ids).alias("ids"))
    each = each.groupBy("doc_id", "digest").agg(F.first("ids").alias("ids"))
    lines = cut(each.select("doc_id", "digest", F.posexplode("ids").alias("i", "id")).select(*PLACE, "id.long", "id.h1", "id.h2"))
    levels, size = {1: _repeated(lines, ["h1", "h2"])}, 1
    while not levels[size].isEmpty():
        if size < min_lines < 2 * size:
            levels[min_lines] = _joined(levels[size], min_lines - size)
        levels[2 * size] = _joined(levels[size], size)
        size *= 2
    del levels[size]
    return levels


def _later(levels: dict[int, DataFrame], min_lines: int) -> DataFrame:
    """Per suffix that counts the longest interval in which it isn't the first: PLACE, ``long``, ``run`` (its lines) and ``first``."""
    out = None
    for size, ranks in levels.items():
        ours = ranks if size >= min_lines else ranks.where("long")
        firsts = cut(ranks.groupBy("rank").agg(F.min(F.struct(*PLACE)).alias("first")))  # a table, so that the join can split a large class
        found = ours.join(firsts, "rank").where(~F.struct(*PLACE).eqNullSafe(F.col("first"))).select(*PLACE, "long", F.struct(F.lit(size).alias("run"), "first").alias("best"))
        out = found if out is None else out.unionByName(found)
    return out.groupBy(*PLACE, "long").agg(F.max("best").alias("best")).select(*PLACE, "long", "best.run", "best.first")


def _starts(later: DataFrame) -> DataFrame:
    """Where runs begin: places whose predecessor isn't a copy of what stands before the earlier copy. Lines that count alone always do."""
    along = W.partitionBy("doc_id", "digest").orderBy("i")
    before = F.lag(F.struct("i", "first")).over(along)
    on = (before["i"] + 1 == F.col("i")) & before["first"]["doc_id"].eqNullSafe(F.col("first.doc_id")) & (before["first"]["digest"] == F.col("first.digest")) & (before["first"]["i"] + 1 == F.col("first.i"))
    return later.withColumn("on", F.coalesce(on, F.lit(False))).where("not on or long").drop("on")


def _measured(starts: DataFrame, levels: dict[int, DataFrame]) -> DataFrame:
    """``starts`` with ``run`` as the longest common prefix with the earlier copy."""
    powers = sorted((k for k in levels if k & (k - 1) == 0), reverse=True)
    for size in powers[1:]:
        ranks = levels[size]
        open_ = starts.where(F.col("run") > size)
        own = ranks.select(F.col("doc_id").alias("a_id"), F.col("digest").alias("a_digest"), F.col("i").alias("a_i"), F.col("rank").alias("a"))
        other = ranks.select(F.col("doc_id").alias("b_id"), F.col("digest").alias("b_digest"), F.col("i").alias("b_i"), F.col("rank").alias("b"))
        met = open_.join(own, F.expr("doc_id <=> a_id and digest = a_digest and i + run = a_i"), "left").join(other, F.expr("first.doc_id <=> b_id and first.digest = b_digest and first.i + run = b_i"), "left")
        longer = met.withColumn("run", F.col("run") + F.when(F.col("a") == F.col("b"), F.lit(size)).otherwise(F.lit(0)))
        starts = cut(longer.select(*starts.columns).unionByName(starts.where(F.col("run") <= size)))
    return starts


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """The maximal runs of non-blank lines that also begin earlier, by doc_id and then place, and have ``min_lines`` lines or begin with one of
    ``min_words`` words.

    Returns a row per document with such runs: ``doc_id``, ``digest`` (of the text) and ``runs``: ``i`` and ``run``, the first line's place
    among the non-blank ones, from 0, and the number of lines; and ``first``, where the earlier copy is. Runs may overlap.
    """
    levels = suffix_ranks(docs, min_lines, min_words)
    if not levels:
        place = "doc_id: bigint, digest: bigint, i: int"
        return docs.sparkSession.createDataFrame([], f"doc_id long, digest long, runs array<struct<i: int, run: int, first: struct<{place}>>>")
    runs = _measured(cut(_starts(_later(levels, min_lines))), levels)
    return runs.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("i", "run", "first")).alias("runs"))


@releases
def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_removed`` and ``kept_text``, which replace columns of these names.

    Lines end at line feeds. Blank lines (nothing but spaces) are in no run and stay. A null text has no lines and stays null; an
    empty one is one blank line. Rows that are equal in doc_id and text are one document read more than once, and get one
    result; copies under other ids are later ones, a null id coming first. Ties don't arise otherwise. Empty tables stay
    empty; extra columns of any name are kept.
    """
    runs = cut(repeated_lines(docs, min_lines, min_words).select(F.col("doc_id").alias("id"), F.col("digest").alias("name"), F.transform("runs", lambda r: F.struct(r["i"].alias("i"), r["run"].alias("run"))).alias("runs")))
    rows = packed(docs.drop("kept_text", "n_lines", "n_removed"), F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"), "text")
    # only texts that may have a run are shuffled
    marked = possible(rows, F.xxhash64("doc_id", "digest"), bitmap_pieces(runs.select(F.xxhash64("id", "name").alias("key"))))
    touched = marked.where("__maybe").join(runs, F.expr("doc_id <=> id and digest = name"), "left").select("row", "text", "runs")
    whole = marked.where("not __maybe").select("row", "text", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"))
    # per line whether it goes: the place of each non-blank one, from 0, is in a run
    places = f"filter(transform(lines, (x, p) -> if({_blank('x')}, null, p)), p -> p is not null)"
    gone = f"array_distinct(flatten(transform(runs, r -> slice({places}, r.i + 1, r.run))))"
    split = touched.unionByName(whole).withColumn("lines", F.expr(lines_of("text")))
    kept = split.withColumn("gone", F.when(F.col("runs").isNotNull(), F.expr(gone))).withColumn("kept", F.when(F.col("gone").isNotNull(), F.expr("filter(lines, (x, p) -> not array_contains(gone, p))")).otherwise(F.col("lines")))
    count = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    return kept.select("row.*", count("lines").alias("n_lines"), count("gone").alias("n_removed"), F.array_join("kept", "\n").alias("kept_text"))
