import hashlib
import re

from pyspark.sql import functions as F

from tidewheel.llm import decontaminate

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, items):
    windows = {}
    for item, text in items:
        words = WORD.findall((text or "").translate(LOW))
        m = min(10, len(words))
        for i in range(len(words) - m + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + m]), set()).add("" if item is None else str(item))
    for row in rows:
        words = WORD.findall((row[1] or "").translate(LOW))
        hit, found = set(), set()
        for m in {len(w) for w in windows}:
            for i in range(len(words) - m + 1):
                owners = windows.get(tuple(words[i : i + m]))
                if owners:
                    found |= owners
                    hit.update(range(i, i + m))
        yield row[0], len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def found(docs, benchmark):
    return decontaminate.contamination(docs, benchmark).withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256))


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_against_brute_force(spark, docs, rows, same):
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 40]
    items = [(i, " ".join(t.split()[i % 7 : i % 7 + 25])) for i, t in enumerate(texts[:12])]
    items += [(100, "Terms of use"), (101, "naïve, STRASSE!"), (102, ""), (103, None), (104, "all rights reserved terms of use and"), (None, texts[3]), (2, texts[5]), (2, texts[5]), (105, "short")]
    benchmark = spark.createDataFrame([(*x, "extra", 1) for x in items], "item_id long, text string, window string, m int")
    same(found(docs, benchmark), COLUMNS, brute(rows, items))


def test_empty(spark, docs, rows, nothing, same):
    none = spark.createDataFrame([], "item_id long, text string")
    same(found(docs, none), COLUMNS, brute(rows, []))
    assert found(nothing, none).count() == 0
