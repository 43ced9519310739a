"""What the training-data operators share: tables, the shared folder, word hashing, joins back to rows."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Keys up to which a set of keys is broadcast (16 bytes each); beyond that the join shuffles.
BROADCAST_IDS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on one machine, as in tests, a folder of our own where that is unset."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None):
        path = spark.conf.get("spark.checkpoint.dir")
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(path)
        return path
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", sc.master):  # local-cluster has several machines' folders
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder; a lost executor loses none of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def bucketed(df: DataFrame, what: str, key: str, buckets: int) -> DataFrame:
    """df written once to the shared folder, bucketed by key, and read back: groups by key need no further shuffle.

    Spark keeps buckets for tables of the catalog only, so that the table has a name (of its own) there.
    """
    name = f"{what}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", fresh_path(df.sparkSession, name)).saveAsTable(name, format="parquet")
    return df.sparkSession.table(name)


#: What tells rows apart: the id, and a hash of the text, as a doc_id may be null or repeated.
ROW = ("doc_id", "text_key")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and text: one key for rows with the same id and text."""
    return docs.select("doc_id", F.xxhash64(F.col("text").isNull(), "text").alias("text_key"), "text")


def without_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of docs whose key isn't in rows (ROW); null ids are equal. Keys are broadcast only up to BROADCAST_IDS."""
    gone = cut(rows.select(*(F.col(c).alias(f"_{c}") for c in ROW)).distinct())
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    key = F.xxhash64(F.col("text").isNull(), "text") == F.col("_text_key")
    return docs.join(F.broadcast(gone) if few else gone, key & docs["doc_id"].eqNullSafe(gone["_doc_id"]), "left_anti")


def give_back() -> None:
    """Return freed memory to the system; workers live from stage to stage, and what one stage freed another executor part may need."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(f: Callable[..., Iterator[pa.RecordBatch]], **fixed) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f over batches with its other arguments fixed; freed memory is given back after the last batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches, **fixed)
        give_back()

    return run


def crc_bucket(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null for a null id)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % n


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash; a worker keeps it between batches up to a bounded number of words."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer over 64-bit words."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for i in range(k):
        acc = acc * np.uint64(0x100000001B3) + hashes[i : i + n]
        acc ^= acc >> np.uint64(30)
    return mix(acc)
