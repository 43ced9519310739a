"""The relational store: shredding, interning, retrieval, existence, anti-joins, generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from factloom.model import EXPORTED
from factloom.operators.graph import cut

#: Tasks that share a folder of the index by name.
SPREAD = 16


def intern(strings: DataFrame, column: str, partitions: int | None = None) -> DataFrame:
    """str_id, s: dense ids from 1 in the order of the distinct strings.

    The strings are dealt by range, ranked within their range, and lifted by the sizes of the ranges before; no window sees
    more than one range, and only one number per range is shared.
    """
    s = strings.select(F.col(column).alias("s")).where("s is not null").distinct()
    # cut once: a range that is dealt again after a loss must not differ from the one that was counted
    ranked = cut(s.repartitionByRange(*([partitions] if partitions else []), "s").withColumn("part", F.spark_partition_id()).withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("s"))))
    sizes = ranked.groupBy("part").agg(F.max("r").alias("n"))  # one row per range
    before = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranked.join(F.broadcast(before.select("part", "base")), "part").select((F.col("base") + F.col("r")).alias("str_id"), "s")


def shred(files: DataFrame, occurrences: DataFrame, path: str) -> None:
    """Write deduplicated (key, file) rows, replacing only the buckets of files that the input holds (dynamic overwrite).

    A bucket is a fixed hash of file_id, so that any number of files makes a bounded number of folders.
    """
    rows = occurrences.join(files.select("file_id"), "file_id", "left_semi").dropDuplicates(["key", "file_id"]).withColumn("bucket", F.pmod(F.xxhash64("file_id"), F.lit(64)).cast("int"))
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def index_by_name(occurrences: DataFrame, path: str, buckets: int = 64) -> None:
    """Write the inverted index: distinct (key, file_id) in folders by a hash of the key, in order of the key within a file.

    A folder is dealt over SPREAD tasks by file, so that a popular key is no task of its own; the pairs of a task are made
    distinct where they are.
    """
    salt = F.pmod(F.xxhash64("file_id"), F.lit(SPREAD)).alias("salt")
    rows = occurrences.select("key", "file_id", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"), salt)
    rows = rows.repartition("bucket", "salt").distinct().drop("salt")
    rows.sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(path)


def lookup(spark: SparkSession, path: str, keys: tuple[str, ...], buckets: int = 64) -> DataFrame:
    """key, file_id of the index for some keys: only their folders are read, and of those only the row groups that hold them."""
    of = spark.sql("SELECT " + ", ".join(f"cast(pmod(xxhash64('{k}'), {buckets}) AS int)" for k in map(_quoted, keys))).first()
    return spark.read.parquet(path).where(F.col("bucket").isin(*set(of)) & F.col("key").isin(*keys)).select("key", "file_id")


def _quoted(key: str) -> str:
    return key.replace("\\", "\\\\").replace("'", "\\'")


def upsert_by_precedence(rows: DataFrame, key: str, source: str, order: tuple[str, ...]) -> DataFrame:
    """One row per key with its most precedent source; a lower one never demotes it."""
    rank = sum((F.when(F.col(source) == s, F.lit(len(order) - i)).otherwise(0) for i, s in enumerate(order)), F.lit(0))
    return rows.groupBy(key).agg(F.max_by(source, rank).alias(source))


def candidates(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """Files that hold any of the keys; more than the answer, never less."""
    return refs.join(keys, "key", "left_semi").select("file_id").distinct()


def candidates_with_symbols(refs: DataFrame, syms: DataFrame, keys: DataFrame) -> DataFrame:
    """Files on the reference side or on the symbol side of a key set."""
    return candidates(refs, keys).union(candidates(syms, keys)).distinct()


def unused_exports(syms: DataFrame, refs: DataFrame) -> DataFrame:
    """Exported symbols whose key no other file refers to.

    Number and least file of a key's references decide it, so the popular keys are combined before they are shuffled and no
    list of files is ever held against another.
    """
    spread = refs.groupBy("key").agg(F.count("*").alias("n"), F.min("file_id").alias("only"))
    exported = syms.where(F.col("flags").bitwiseAND(EXPORTED) != 0)
    elsewhere = F.coalesce((F.col("n") > 1) | (F.col("only") != F.col("file_id")), F.lit(False))
    return exported.join(spread, "key", "left").where(~elsewhere).select("file_id", "key")


def exists3(rows: DataFrame, probes: DataFrame, indexed: DataFrame, on: list[str]) -> DataFrame:
    """probes with found: true or false for indexed files, null (unknown) for files that are not indexed."""
    hit = rows.select(*on).distinct().withColumn("hit", F.lit(True))
    known = indexed.select("file_id").distinct().withColumn("known", F.lit(True))
    return probes.join(hit, on, "left").join(known, "file_id", "left").withColumn("found", F.when(F.col("known"), F.coalesce("hit", F.lit(False)))).drop("hit", "known")


def collect_garbage(strings: DataFrame, *used: Column | DataFrame) -> DataFrame:
    """Strings whose id none of the used id columns holds (each a one-column DataFrame)."""
    ids = used[0]
    for u in used[1:]:
        ids = ids.union(u)
    ids = ids.toDF("str_id").where("str_id is not null").distinct()
    return strings.join(ids, "str_id", "left_anti")


def as_of(versions: DataFrame, key: str, version: str, pin: int, columns: list[str]) -> DataFrame:
    """Per key the newest row at or below the pin."""
    pick = F.max_by(F.struct(version, *columns), version).alias("x")
    return versions.where(F.col(version) <= pin).groupBy(key).agg(pick).select(key, f"x.{version}", *(f"x.{c}" for c in columns))


def prune(versions: DataFrame, key: str, version: str, keep: int) -> DataFrame:
    """Rows that survive: at or above keep, or the newest of their key below it."""
    newest = F.max(F.when(F.col(version) <= keep, F.col(version))).over(Window.partitionBy(key))
    return versions.withColumn("_n", newest).where((F.col(version) >= keep) | (F.col(version) >= F.col("_n"))).drop("_n")


def repair_frontier(blobs: DataFrame, conclusions: DataFrame, surfaces: DataFrame, pin: int, version: int) -> DataFrame:
    """Paths with a usable blob that lack a conclusion at the pin, or a surface of the version."""
    c = conclusions.where(F.col("generation") <= pin).select("path").distinct().withColumn("c", F.lit(1))
    s = surfaces.where(F.col("version") == version).select("path").distinct().withColumn("s", F.lit(1))
    return blobs.select("path").distinct().join(c, "path", "left").join(s, "path", "left").where("c is null or s is null").select("path")


def insert_if_current(stubs: DataFrame, sources: DataFrame) -> DataFrame:
    """Stubs whose source still carries the stamp (path, mtime, size) they were made from."""
    return stubs.join(sources.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_semi")


def first_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The winner of each key by a total order, as one aggregate: no key's rows are sorted together."""
    rest = [c for c in rows.columns if c not in key]
    pick = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("x")
    return rows.groupBy(*key).agg(pick).select(*key, "x.*")
