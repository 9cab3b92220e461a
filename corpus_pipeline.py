"""A corpus pipeline: quality filter, exact and near deduplication, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.

Defined results: null text counts as empty in every stage; empty texts are scored like any, equal each other
and are similar to none, and go in the mix, which takes no words of them; rows without an id take part
everywhere and come last among equals and near copies; rows that share an id by chance are rows of their
own; an empty table gives an empty result; columns besides id, text and source pass as they are. Rows
are chosen by number, so what one stage drops is what it says it drops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievemark.llm import exact_dedup, mixing, ngram_join, packing, quality
from sievemark.llm.common import materialize, read_table, release


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the table's own labels, doesn't reject."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word Jaccard similarity of 0.8 or more, the one with the least doc_id."""
    return ngram_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources by weight: documents repeated, cut or left out as the mix takes them."""
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality", good_quality), ("exact_dedup", without_copies), ("ngram_join", without_near_copies), ("mixing", mixed), ("packing", packed)]

#: SQL can't express the classifier or the token ids; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        later = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if n:
            release(docs)
        docs = later
    return STAGES[-1][1](spark, docs, sf_dir)
