"""The thin queries ``opN_<name>`` and their SQL, for the driver's tables."""

from __future__ import annotations

from . import exact_dedup, language_id, mixing, near_dedup, quality_model, quality_rules, sentencepiece, suffix_dedup, toxicity, url_filter
from .common import table


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


def op2_sentencepiece(spark, sf_dir, model_file=sentencepiece.MODEL):
    return sentencepiece.encoded(table(spark, sf_dir, "documents"), sentencepiece.load(model_file))


def op3_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_model.quality(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.language_id(docs, language_id.train(docs))


def op10_url_filter(spark, sf_dir):
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_sentencepiece, op3_mixing, op4_quality, op5_toxicity, op6_near_dedup, op7_quality_rules, op8_exact_dedup, op9_language_id, op10_url_filter)}
ORACLES = {"op8_exact_dedup": exact_dedup.ORACLE, "op10_url_filter": url_filter.ORACLE}
