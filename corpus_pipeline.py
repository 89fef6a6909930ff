"""A training-data pipeline: each stage takes (spark, docs, sf_dir) and keeps or rewrites rows of documents.

Defined cases, for all stages: an empty table stays empty; repeated rows are rows of their own, until near-dedup leaves one of them; extra columns
stay, and are the last stage's too, whose added columns give way to them by underscores. Texts are taken whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeslab.llm import decontaminate, mixing, neardup, pii, quality
from treeslab.llm.queries import TEST_KEY
from treeslab.llm.shared import spool, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or whose lines are mostly boilerplate go. Null and empty texts fail; a null id or no label changes nothing."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least doc_id (null first, then by text). Links are at 0.8 or more.

    Documents without words are in no group and stay.
    """
    return neardup.keep_first(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none and stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by surrogates, once they are known to be distinct."""
    key = pii.key_of(spark) or TEST_KEY
    return pii.mask(pii.checked(docs, key), key)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes stay, with the number of copies it takes (mix_copies) and their words (mix_words).

    A null source is a source; documents without words are taken with their source's hash threshold. A target may be far where a source has few documents.
    """
    return mixing.mixture(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii_surrogates),
    ("mixing", source_mixing),
]

#: SQL cannot express the CRF, the surrogates or the hash thresholds; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else spool(docs), sf_dir)
    return docs
