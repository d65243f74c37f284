"""Token counts without token ids.

A byte-level BPE tokenizer cuts a text into pre-tokens and each of them into pieces, whatever stands around it. So the
pieces of each distinct pre-token are counted once, in a table, and a document's count is the sum over its pre-tokens
of frequency times pieces.

The join of the two follows the frequencies' shape. The HEAD most frequent pre-tokens, which make up most of any text, are
joined in the scan with a broadcast of bounded size, so their frequencies never leave the task. The other ones are
rare each, and are joined by a shuffle.
"""

from __future__ import annotations

import functools
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, cut, releases, slices, valid

#: Pre-tokens in the broadcast, and their longest length in bytes: 32 MB at the very most.
HEAD, HEAD_BYTES = 1 << 17, 256
#: Distinct pre-tokens that a task gathers before it hands on their counts, and bytes of text.
GATHER, GATHER_BYTES = 150_000, 64 << 20

#: The pattern that byte-level BPE vocabularies of this family are made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this character, regex and tokenizers agree on what is a letter, a number or a space.
AGREED = 0x558


class PreTokens:
    """Cuts texts as a tokenizer of tokenizers' JSON format does: byte-level, special strings apart."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(spec)
        self.check(spec)
        self.cut_known = regex.compile(PATTERN).findall
        self.unknown = regex.compile(f"[^\\x00-{chr(AGREED - 1)}]").search
        specials = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None

    @staticmethod
    def check(spec: str) -> None:
        import json

        said = json.loads(spec)
        cutter = said.get("pre_tokenizer") or {}
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in said.get("added_tokens", []))
        if said["model"]["type"] != "BPE" or said.get("normalizer") or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True) or not plain:
            raise ValueError("only byte-level BPE with plain special strings and without a normaliser counts by pre-tokens")

    def of(self, text: str) -> tuple[list[str], int]:
        """A text's pre-tokens, and how many special strings it holds."""
        if self.specials is None or not self.specials.search(text):
            return self._cut(text), 0
        parts = self.specials.split(text)
        return [p for part in parts for p in self._cut(part)], len(parts) - 1

    def _cut(self, text: str) -> list[str]:
        if text.isascii() or not self.unknown(text):
            return self.cut_known(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, pretokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(pretokens, add_special_tokens=False)]


@functools.lru_cache(2)
def pretokens(spec: str) -> PreTokens:
    return PreTokens(spec)


def _texts(cols: dict) -> Iterator[str]:
    return (t.decode() for t in cols["text"])


def _vocabulary(texts: DataFrame, spec) -> DataFrame:
    """``p`` (pre-token) and ``n`` (occurrences), once per distinct pre-token."""

    def rows(counts: Counter) -> Iterator[pa.RecordBatch]:
        """In batches that long pre-tokens end early."""
        keys, values, size = [], [], 0
        for p, n in counts.items():
            keys.append(p)
            values.append(n)
            size += len(p) + 16
            if size > SLICE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.int64())], names=["p", "n"])
                keys, values, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.int64())], names=["p", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, counts, size = pretokens(spec.value), Counter(), 0
        for cols in slices(batches, "text"):
            for text in _texts(cols):
                counts.update(cutter.of(text)[0])
            size += sum(map(len, cols["text"]))
            if len(counts) > GATHER or size > GATHER_BYTES:
                yield from rows(counts)
                counts, size = Counter(), 0
        yield from rows(counts)

    return texts.mapInArrow(run, "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))


def _pieces(vocabulary: DataFrame, spec) -> DataFrame:
    """``vocabulary`` with ``pieces``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = pretokens(spec.value)
        for cols in slices(batches, "p"):
            found = [p.decode() for p in cols["p"]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(cols["n"], pa.int64()), pa.array(cutter.pieces(found), pa.int32())], names=["p", "n", "pieces"])

    return vocabulary.mapInArrow(run, "p string, n long, pieces int")


def _most_frequent(table: DataFrame) -> DataFrame:
    """The pre-tokens above the least frequency class (16 to a doubling) that leaves at most HEAD of them; no sort is needed."""
    short = table.where(F.octet_length("p") <= HEAD_BYTES).withColumn("size", F.floor(F.log2("n") * 16))
    left, least = HEAD, None
    for row in short.groupBy("size").count().orderBy(F.desc("size")).collect():  # at most 16 x 63 classes
        left -= row["count"]
        if left < 0:
            break
        least = row["size"]
    return short.where(F.col("size") >= least) if least is not None else short.limit(0)


@releases
def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """Tokens of every row of ``docs`` (doc_id, text) as the tokenizer of the file ``tokenizer`` (tokenizers' JSON) gives them.

    Nothing is added at the ends; special strings inside texts are one token each, as is the library's default. Returns one row
    per row: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit``).

    Null texts are empty: 0 bytes, 0 tokens. Bytes that are no UTF-8 are read, and counted, as replacement characters. Rows that share an id or a text are counted each for itself. Empty tables give
    empty results. Extra columns are left out.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    pretokens(text)  # fails here, not in a task
    spec = spark.sparkContext.broadcast(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(valid(), F.lit("")).alias("text"))
    table = cut(_pieces(_vocabulary(rows.select("text"), spec), spec))
    head = spark.sparkContext.broadcast({r.p: r.pieces for r in _most_frequent(table).select("p", "pieces").toLocalIterator()})
    target = "doc_id long, n_bytes long, n_head long, tail array<struct<p:string,n:int>>"
    tail_type = pa.list_(pa.struct([("p", pa.string()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, known = pretokens(spec.value), head.value
        for cols in slices(batches, "text"):
            sums, tails = [], []
            for text in _texts(cols):
                found, total = cutter.of(text)
                tail = []
                for p, n in Counter(found).items():
                    pieces = known.get(p)
                    if pieces is None:
                        tail.append((p, n))
                    else:
                        total += pieces * n
                sums.append(total)
                tails.append([{"p": p, "n": n} for p, n in tail])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols["doc_id"], pa.int64()), pa.array([len(t) for t in cols["text"]], pa.int64()), pa.array(sums, pa.int64()), pa.array(tails, tail_type)],
                names=["doc_id", "n_bytes", "n_head", "tail"],
            )

    each = cut(rows.mapInArrow(run, target).withColumn("rid", F.monotonically_increasing_id()))
    tail = each.select("rid", F.explode("tail").alias("t")).select("rid", "t.p", "t.n")
    sums = tail.join(table.select("p", "pieces"), "p").groupBy("rid").agg(F.sum(F.col("n") * F.col("pieces")).alias("n_tail"))
    total = F.col("n_head") + F.coalesce("n_tail", F.lit(0))
    return each.select("rid", "doc_id", "n_bytes", "n_head").join(sums, "rid", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
