"""A training-data pipeline over ``documents``: language, near-duplicates, passages, benchmark, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Decisions are on rows, told apart by doc_id and text, so that
a null doc_id or one that stands twice is no exception; rows with the same doc_id and text are one document repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm import decontaminate, lang_id, near_dup, suffix_dedup, trie_bpe
from factloom.llm.common import ROW, cut, fresh_path, keyed, table, without_rows
from factloom.llm.q_text import vocabulary

#: A document stays if its most likely language has this share of its probability at least.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter or with no likely language go."""
    model = lang_id.fit(docs, vocabulary("piece_bpe_32k.model"))
    docs = docs.where(F.col("text").rlike(r"\p{L}"))
    if not model.langs:
        return docs
    return without_rows(docs, lang_id.identify(keyed(docs), model, ROW).where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SHARE)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more): the first by doc_id (null last) and text.

    Rows repeated under one doc_id and text are one document, of which one row stays; rows without words are linked with nothing.
    """
    found = cut(near_dup.near_duplicates(keyed(docs), keys=ROW, labelled=True).where("label is not null").select(*ROW, "label"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), *ROW)
    first = found.groupBy("label").agg(F.min(place).alias("x")).select(F.col("x.doc_id").alias("first_id"), F.col("x.text_key").alias("first_key"))
    is_first = (F.col("text_key") == F.col("first_key")) & F.col("doc_id").eqNullSafe(F.col("first_id"))  # by row, not by label: a group may be large
    kept = without_rows(docs, found.join(first, is_first, "left_anti"))
    repeated = cut(found.groupBy(*ROW).count().where("count > 1").select(*ROW))
    if repeated.isEmpty():
        return kept
    names = kept.columns
    kept = kept.withColumn("_row_key", F.xxhash64(F.col("text").isNull(), "text"))
    again = repeated.select(F.col("doc_id").alias("_again_id"), F.col("text_key").alias("_again_key"))
    same = (F.col("_row_key") == F.col("_again_key")) & F.col("doc_id").eqNullSafe(F.col("_again_id"))
    once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "_row_key"])
    return kept.join(again, same, "left_anti").unionByName(once).select(*names)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand in a document of a smaller doc_id."""
    out = suffix_dedup.dedup(docs, text_too=True).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return without_rows(docs, decontaminate.contaminated(keyed(docs), table(spark, sf_dir, "benchmark"), ROW))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded text."""
    out = trie_bpe.encode(docs, vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "ids")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("decontamination", decontamination), ("tokens", tokens)]

#: Trained models and a tokenizer's vocabulary are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each but the last returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
