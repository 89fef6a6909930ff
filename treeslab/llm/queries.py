"""The queries of the operators, as the driver runs them, and their SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeslab.llm import chat, decontaminate, fmindex, lattice, mixing, neardup, oracles, pii, quality, suffixes, urls
from treeslab.llm.shared import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: Key of the surrogates in queries over test tables. Real texts need a secret one, in the session's spark.treeslab.pii.key.
TEST_KEY = "not a secret: for test tables only"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = pii.key_of(spark) or TEST_KEY
    return pii.report(pii.checked(table(spark, sf_dir, "documents"), key), key)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, urls.LISTED))).alias("key"))
    return urls.judge(table(spark, sf_dir, "pages"), listed)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crf = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, crf)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_decontamination, op2_pii, op3_mixing, op4_lm_scoring, op5_url_filters, op6_suffix_array_dedup, op7_near_dedup, op8_chat_formatting, op9_quality, op10_substring_dedup)
}
ORACLE: dict[str, str] = {
    "op1_decontamination": oracles.OP1,
    "op3_mixing": oracles.OP3,
    "op5_url_filters": urls.oracle(),
    "op7_near_dedup": oracles.OP7,
    "op8_chat_formatting": chat.ORACLE,
    "op10_substring_dedup": oracles.OP10,
}
