"""What the operators share: lineage cuts in the shared folder, text batches for Python stages."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that a Python stage handles at once, so that its memory doesn't follow the batch.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch. Rows hold whole texts, so Spark's 10,000 would take a hundred MB in each of JVM and Python.
BATCH_ROWS = 1_000
#: Bits of a bitmap that goes to all executors: 4 MB, whatever the tables' size.
BITMAP_BITS = 1 << 25

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one machine only, one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):  # each executor would write to its own disk, and reads would miss the others' rows
        raise RuntimeError("spark.checkpoint.dir isn't set; the operators need a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="tidewheel-"))
    return f"file://{_own_folder[0]}"


def tune(spark: SparkSession) -> None:
    """Small Arrow batches for the session, where its setting is still the default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Write a frame as a table in the shared folder and read it again.

    This cuts the lineage like checkpoint(), which would compute the last stage twice. Lost executors
    don't lose the rows. Inside an operator marked ``releases`` the files go when it returns, but for those that its result reads; these
    go when the driver's Python ends.
    """
    spark = df.sparkSession
    tune(spark)
    path = f"{shared_folder(spark)}/tidewheel/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scopes[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Tables written and not removed yet: those of no operator first, and then those of each operator that is running.
_scopes: list[list[tuple[SparkSession, str]]] = [[]]


def releases(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Remove the tables that an operator has written, once it returns a frame, except those that the frame reads."""

    @functools.wraps(operator)
    def run(*args, **more):
        _scopes.append([])
        try:
            out = operator(*args, **more)
        except BaseException:
            _remove(_scopes.pop())
            raise
        written = _scopes.pop()
        read = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in out.inputFiles()} if written else set()
        kept = [w for w in written if w[1].rsplit("/", 1)[-1] in read]
        _remove([w for w in written if w not in kept])
        _scopes[-1] += kept
        return out

    return run


def _remove(written: list[tuple[SparkSession, str]]) -> None:
    for spark, path in written:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_all() -> None:
    for written in _scopes:
        with contextlib.suppress(Exception):  # the session may have ended before
            _remove(written)


def give_back() -> None:
    """Return freed memory to the system; workers live on after a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[dict[str, list]]:
    """The batches' columns as lists, in slices of at most SLICE_BYTES of text (one row at least); the text as bytes, null as
    empty."""
    give_back()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        start = total = 0
        for row, size in enumerate([*sizes, None]):
            if size is None or (total and total + size > SLICE_BYTES):
                if row > start:
                    part = batch.slice(start, row - start)
                    lists = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                    raw = lists.pop(text)
                    raw = raw.cast(pa.large_binary() if pa.types.is_large_string(raw.type) else pa.binary()).to_pylist()
                    yield {n: c.to_pylist() for n, c in lists.items()} | {text: [x or b"" for x in raw]}
                start, total = row, 0
            total += size or 0
    give_back()


def map_texts(df: DataFrame, work: Callable[[dict[str, list]], dict[str, list]], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow over slices(): ``work`` gets a slice's columns and returns the columns of ``schema``."""
    tune(df.sparkSession)
    target = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in slices(batches, text):
            out = work(cols)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.withColumn(text, valid(text)).mapInArrow(run, target)


def valid(text: str = "text") -> Column:
    """A text whose bytes that are no UTF-8 are replacement characters, as Python would refuse them."""
    return F.make_valid_utf8(F.col(text))


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """The rows of ``docs`` as one column ``row``, beside an operator's own columns, so that none of its names can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *more)


def bitmap_pieces(keys: DataFrame, size: int = BITMAP_BITS) -> DataFrame:
    """``size`` bits (a power of two), on where a ``key`` (long) modulo their number falls, as rows of ``bucket`` and ``bits`` (4 KB)."""
    place = F.pmod("key", F.lit(size))
    return keys.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))


def possible(rows: DataFrame, key: Column, pieces: DataFrame, size: int = BITMAP_BITS) -> DataFrame:
    """``rows`` with ``__maybe``: whether the bitmap has the key's bit. The pieces, ``size`` / 8 bytes at most, are broadcast."""
    small = F.broadcast(pieces.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits")))
    placed = rows.withColumn("__p", F.pmod(key, F.lit(size)))
    bit = F.expr("bitmap_bit_position(__p)")
    byte = F.conv(F.hex(F.substring("__bits", F.call_function("div", bit, F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = placed.join(small, F.expr("bitmap_bucket_number(__p) = __bucket"), "left")
    return found.withColumn("__maybe", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop("__p", "__bucket", "__bits")


def bitmap(keys: DataFrame, size: int = BITMAP_BITS) -> bytes:
    """The bits of bitmap_pieces in one piece, for Python stages; they reach the driver 4 KB at a time."""
    bits = np.zeros(size // 8 + 4096, np.uint8)
    for row in bitmap_pieces(keys, size).toLocalIterator():
        # bucket b holds the places (b - 1) * 32768 + 1 to b * 32768, the first at bit 0
        start = (row.bucket - 1) * 4096
        raw = np.frombuffer(bytes(row.bits), np.uint8)
        if start < 0:  # place 0 alone falls below bucket 1
            bits[-1] |= 1
        else:
            bits[start : start + len(raw)] |= raw
    return bits.tobytes()


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes & np.uint64((len(bits) - 4096) * 8 - 1)).astype(np.int64)
    at = np.where(place == 0, 0, place - 1)
    got = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
    return np.where(place == 0, bits[-1] & 1, got).astype(bool)


def md5_long(value: Column) -> Column:
    """The first 60 bits of a string's MD5, which other SQL engines compute alike."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("long")


def digest(text: str = "text") -> Column:
    """64 bits of a text. With the id they name a row, up to rows that are equal in both."""
    return F.xxhash64(F.col(text))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, digest of text) isn't in ``gone`` (doc_id, digest); nulls equal each other.

    A bitmap of fixed size tells for most of the rows that stay, in the scan, that they aren't in ``gone``; only the others
    are shuffled to the join.
    """
    marks = cut(gone.select(F.col("doc_id").cast("long").alias("id"), F.col("digest").alias("name")).distinct())
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(marks.select(F.xxhash64("id", "name").alias("key"))))

    @F.pandas_udf("boolean")
    def maybe(keys):
        return pd.Series(in_bitmap(np.frombuffer(bits.value, np.uint8), keys.to_numpy(np.int64).view(np.uint64)))

    rows = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"))
    marked = rows.withColumn("maybe", maybe(F.xxhash64("doc_id", "digest")))
    kept = marked.where("maybe").join(marks, F.expr("doc_id <=> id and digest = name"), "left_anti")
    return marked.where("not maybe").select("row.*").unionByName(kept.select("row.*"))
