"""Fact relations over the driver's tables: each view is a lazy DataFrame, and its SQL twin serves the oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factloom.model import EXPORTED, LINKAGE

TOKEN = "[a-z]{4,}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, path, source, lang: documents as files of two tiers."""
    tier = F.when(F.substring("source", 4, 9).cast("int") < 10, "workspace").otherwise("import")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat(F.lit("doc/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), tier.alias("source"), "lang")


def _tokens() -> Column:
    return F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))


def occurrences(spark: SparkSession, sf_dir: str, of: DataFrame | None = None, keys: tuple[str, ...] | None = None) -> DataFrame:
    """file_id, pos (ordinal), key: every token of every document, or of those in of (file_id), which are chosen before texts are split.

    With keys only theirs: texts that hold none are not split, and other tokens go where they are made.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "text")
    if of is not None:
        docs = docs.join(of.select("file_id"), "file_id", "left_semi")
    if keys is None:
        return docs.select("file_id", F.posexplode(_tokens()).alias("pos", "key"))
    held = reduce(Column.__or__, [F.contains(F.lower("text"), F.lit(k)) for k in keys])
    return docs.where(held).select("file_id", F.posexplode(_tokens()).alias("pos", "key")).where(F.col("key").isin(*keys))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, key: a set of pairs; counts over it are counts of files.

    A file is one row of documents, so its set is made within the row and nothing is shuffled.
    """
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.explode(F.array_distinct(_tokens())).alias("key"))


def syms(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] | None = None) -> DataFrame:
    """file_id, key, kind, start_at, flags: the tokens of labelled documents as symbols; exported where of quality in the workspace."""
    tokens = occurrences(spark, sf_dir, declaring(spark, sf_dir), keys)
    first = tokens.groupBy("file_id", "key").agg(F.min("pos").alias("start_at"))
    return first.join(declaring(spark, sf_dir), "file_id").select("file_id", "key", "kind", "start_at", "flags")


def declaring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, kind, flags: the labelled documents, and what their symbols are."""
    kind = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).when(F.col("lang") == "de", 3).otherwise(4)
    flags = F.when((F.col("quality") == 1) & (F.col("source") == "workspace"), LINKAGE | EXPORTED).otherwise(LINKAGE)
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id"), "quality")
    return files(spark, sf_dir).join(labelled, "file_id").select("file_id", kind.alias("kind"), flags.alias("flags"))


#: SQL twins, as common table expressions.
FILES_SQL = "files AS (SELECT doc_id AS file_id, 'doc/' || lang || '/' || doc_id AS path, CASE WHEN CAST(substr(source, 4) AS INT) < 10 THEN 'workspace' ELSE 'import' END AS source, lang FROM documents)"
OCC_SQL = f"occ AS MATERIALIZED (SELECT file_id, unnest(range(len(l))) AS pos, unnest(l) AS key FROM (SELECT doc_id AS file_id, regexp_extract_all(lower(text), '{TOKEN}') AS l FROM documents))"
REFS_SQL = f"{OCC_SQL}, refs AS (SELECT DISTINCT file_id, key FROM occ)"
SYMS_SQL = f"""{FILES_SQL}, {REFS_SQL}, syms AS MATERIALIZED (
  SELECT o.file_id, o.key, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END AS kind, min(o.pos) AS start_at,
    CASE WHEN quality = 1 AND files.source = 'workspace' THEN {LINKAGE | EXPORTED} ELSE {LINKAGE} END AS flags
  FROM occ o JOIN labels ON o.file_id = doc_id JOIN files ON o.file_id = files.file_id GROUP BY o.file_id, o.key, lang, quality, files.source)"""
