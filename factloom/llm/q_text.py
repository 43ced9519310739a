"""Queries over ``documents`` for BPE and near-duplicates, with the digests that their contracts name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm import lang_id, near_dup, token_alignment, trie_bpe
from factloom.llm.common import crc_bucket, table


def vocabulary(name: str) -> str:
    """Path of one of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows whose crc32 leaves 2 by 4 are held out of the fit."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    model = lang_id.fit(docs.where(~held_out), vocabulary("piece_bpe_32k.model"))
    return lang_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded text of every document."""
    out = trie_bpe.encode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, threshold=(85, 100))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document, with the links' corpus-wide counts."""
    out = token_alignment.aligned(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    size = lambda c: (F.octet_length(c) / 4).cast("long")
    return out.select("doc_id", size("a_ids").alias("n_a"), size("b_ids").alias("n_b"), "n_groups", "n_links", "n_best", "count_sum", F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"))


QUERIES = {"op12_token_alignment": op12_token_alignment, "op1_lang_id": op1_lang_id, "op4_bpe": op4_bpe, "op5_near_dup": op5_near_dup}
ORACLES: dict[str, str] = {}
