"""A training-data pipeline over ``documents``: each stage's result is written as Parquet and read by the next.

toxicity -> exact_dedup -> near_dedup -> mixing -> sentencepiece
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, mixing, near_dedup, sentencepiece, toxicity
from sparkloom.llm.common import dropped, stored, table


def _row_key() -> Column:
    """A row by doc_id and text, null-safe: 0 to 2^62 - 1."""
    return F.pmod(F.xxhash64(F.isnull("doc_id"), "doc_id", F.isnull("text"), "text"), F.lit(1 << 62))


def _one_of_each(docs: DataFrame, key: Column, several: DataFrame) -> DataFrame:
    """``docs`` with one row, of the longest text, of each ``key`` that ``several(key)`` has; all rows of other keys."""
    rows = docs.select(F.struct("*").alias("doc"), key.alias("key"))
    order = F.struct(-F.length(F.coalesce("doc.text", F.lit(""))), F.xxhash64(*(F.col("doc")[c] for c, kind in docs.dtypes if "map<" not in kind)))
    one = rows.join(several, "key", "left_semi").groupBy("key").agg(F.min_by("doc", order).alias("doc"))
    return rows.join(several, "key", "left_anti").select("doc.*").union(one.select("doc.*"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; null and empty texts stay."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one row stays, whatever the doc_ids: of the longest text, then the least doc_id."""
    verdicts = stored(exact_dedup.exact_dedup(docs))
    gone = verdicts.where("NOT kept").select(F.col("doc_id").alias("g_id"), F.col("text_sha256").alias("g_text")).distinct()
    content = F.sha2(exact_dedup.normalised(), 256)  # text_sha256: equal if the texts are but for white space
    left = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (content == F.col("g_text")), "left_anti")
    several = stored(verdicts.where("kept AND group_size > 1").groupBy(F.col("text_sha256").alias("key")).count().where("count > 1").select("key"))
    return left if several.isEmpty() else _one_of_each(left, content, several)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, the one of least doc_id: shingles of five words, similarity 0.8 or more.

    Rows are told by doc_id and text together, so that rows without doc_id, or with a shared one, are documents too.
    """
    keyed = docs.select(_row_key().alias("key"), "doc_id", "text")
    verdicts = stored(near_dedup.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text"), words=5, percent=80))
    verdicts = verdicts.where("n_shingles > 0").select(F.col("doc_id").alias("key"), F.col("component_id").alias("component"), "kept")
    groups = verdicts.where("NOT kept").select("component").distinct()
    members = stored(verdicts.join(groups, "component", "left_semi").select("key", "component").distinct().join(keyed.select("key", "doc_id"), "key"))
    stays = members.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "key")).alias("first")).select(F.col("first.key").alias("key"))
    gone = members.join(stays, "key", "left_anti").select(F.col("key").alias("g_key")).distinct()
    left = docs.join(gone, _row_key() == F.col("g_key"), "left_anti")
    several = stored(verdicts.groupBy("key").count().where("count > 1").select("key"))
    return left if several.isEmpty() else _one_of_each(left, _row_key(), several)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed by weight: a row for each whole pass over a document, one for its share of the last pass."""
    return mixing.mixed_documents(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256, round_trip of every row of the mix."""
    return sentencepiece.encoded(docs, sentencepiece.load())


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Classifier scores, hash permutations and token ids aren't SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
