"""Queries of passage removal and of benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm import decontaminate, substring_dedup, suffix_dedup
from factloom.llm.common import table


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region of a document that holds a benchmark passage: one row for each document, item and region."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses to passages that stand in documents of smaller doc_id."""
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", n.alias("n_bytes"), (n - F.octet_length("kept_bytes")).alias("n_removed"), F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses to passages of 50 words that stand in documents of smaller doc_id."""
    out = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op2_decontamination": op2_decontamination, "op9_suffix_dedup": op9_suffix_dedup, "op13_substring_dedup": op13_substring_dedup}
ORACLES: dict[str, str] = {}
