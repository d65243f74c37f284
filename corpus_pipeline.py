"""The corpus pipeline: STAGES over documents, each written as Parquet and read again as the next one's docs.

Quality classifier, near-duplicates, benchmark decontamination, mixing, sharding. The order puts what drops most, and
costs a scan only, first. Stages keep extra columns of any name and give empty tables for empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import decontaminate, mixing, quality, sharding, simhash
from tidewheel.llm.common import cut, without
from tidewheel.llm.queries import MIX_SEED, MIX_WEIGHTS, SHARDS, domain_of, table

#: The mix keeps this share of the words that reach it, and takes no document twice.
MIX_RATIO, MIX_EPOCHS = 0.8, 1


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant, fitted on the labelled ones outside the held-out fifth, gives 0.3 or more.

    Null texts count as empty ones, bytes that are no UTF-8 as replacement characters; equal texts fare alike; without labels all score 0.5 and
    stay.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels").where(~quality.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles of Jaccard similarity 0.8 or more.

    That of the smallest doc_id stays (a null one comes last), of rows equal in id and text one. Null and wordless texts are one group.
    """
    return simhash.similar_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null and wordless texts stay; an empty benchmark drops nothing."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated").select("doc_id", "digest"))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the budgets of the domain-language-source tree select, once each.

    Null levels are a leaf of their own. Null and wordless texts go with the prefix around them; a leaf without a word has no budget. Rows of
    one id are taken together or not at all.
    """
    return mixing.mix(docs, MIX_WEIGHTS, MIX_RATIO, MIX_EPOCHS, MIX_SEED, domain_of(F.col("source"))).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its slot and shard, which replace columns of these names; a null id is placed as empty text."""
    return sharding.place(docs, SHARDS)


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", target_mix),
    ("sharding", shards),
]

#: The classifier and the fingerprints are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
