"""Queries of the quality rules and of the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm import quality_qda, quality_rules, text_stats
from factloom.llm.common import crc_bucket, cut, table


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, fixed rules and the verdict of the learned list for every document."""
    stats = cut(text_stats.statistics(table(spark, sf_dir, "documents")))
    out = quality_rules.apply_rules(stats, quality_rules.fit(stats, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction for every document; rows whose crc32 leaves 1 by 3 are held out of the fit."""
    stats = cut(text_stats.statistics(table(spark, sf_dir, "documents")))
    held_out = F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False))
    model = quality_qda.fit(stats.where(~held_out), table(spark, sf_dir, "labels"))
    return quality_qda.score(stats, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_quality_rules": op6_quality_rules, "op7_quality_classifier": op7_quality_classifier}
ORACLES: dict[str, str] = {}
