import numpy as np
from pyspark.sql import functions as F

from tidewheel.llm import common


def test_bitmaps_agree(spark):
    size = 1 << 17
    keys = [0, 1, 32767, 32768, 32769, 65536, size - 1, size, -1, -size, 2**62 + 5, -(2**63)]
    frame = spark.createDataFrame([(k,) for k in keys], "key long")
    bits = np.frombuffer(common.bitmap(frame, size), np.uint8)
    asked = keys + [7, 40000, 99999, -12345]
    expected = [any((k - a) % size == 0 for k in keys) for a in asked]
    assert common.in_bitmap(bits, np.array(asked, np.int64).view(np.uint64)).tolist() == expected
    rows = spark.createDataFrame([(a,) for a in asked], "a long")
    got = {r.a: r["__maybe"] for r in common.possible(rows, F.col("a"), common.bitmap_pieces(frame, size), size).collect()}
    assert [got[a] for a in asked] == expected
    none = common.possible(rows, F.col("a"), common.bitmap_pieces(frame.limit(0), size), size)
    assert not any(r["__maybe"] for r in none.collect())


def test_without(docs, rows, spark):
    marks = docs.select(F.col("doc_id"), common.digest().alias("digest")).where("doc_id % 3 = 0 or doc_id is null")
    kept = common.without(docs, marks)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in rows if r[0] is not None and r[0] % 3)


def test_slices_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(common, "SLICE_BYTES", 10)
    texts = ["abcd", None, "efgh", "x" * 50, "", "é" * 4, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["i", "text"])
    got = list(common.slices([batch, batch.slice(0, 0)]))
    assert [c["i"] for c in got] == [[0, 1, 2], [3, 4], [5, 6]] or [i for c in got for i in c["i"]] == list(range(7))
    assert [t for c in got for t in c["text"]] == [(t or "").encode() for t in texts]
    assert all(sum(map(len, c["text"])) <= 10 or len([t for t in c["text"] if t]) == 1 for c in got)
