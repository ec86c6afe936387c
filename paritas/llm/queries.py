"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import boosting, hashing, jaccard, mixing, neardup, pieces, privacy, quality, sharding, spelling, warc, webtext, whitening
from .common import table
from .oracles import MIX, QUALITY, SPELLING, WARC


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op2_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.report(table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webtext.main_text(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.tokenised(table(spark, sf_dir, "documents"))


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.nearest(table(spark, sf_dir, "embeddings"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.judged(table(spark, sf_dir, "documents"))


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosting.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assignments(table(spark, sf_dir, "documents"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mix_sources, op2_private_data, op3_main_text, op4_quality_rules, op5_piece_tokens, op6_nearest_vectors,
        op7_near_duplicates, op8_quality_trees, op9_uniform_shards, op10_warc_round_trip,
        op11_spelling_variants, op12_whitened_embeddings, op13_ngram_join)
}

ORACLE: dict[str, str] = {"op1_mix_sources": MIX, "op4_quality_rules": QUALITY, "op10_warc_round_trip": WARC,
                          "op11_spelling_variants": SPELLING}
