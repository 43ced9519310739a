"""Incremental maintenance over change streams: debounce, fingerprints, stale generations, dirty propagation.

Every stateful rule has a batch twin with the same answers, which the tests hold the stream against.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_changes(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of change events from Parquet files that keep coming; files_per_batch bounds a micro-batch (back-pressure)."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def debounce(changes: DataFrame, key: str, ts: str, gap: str, value: str) -> DataFrame:
    """The newest change of each burst (key, changes closer than gap): works on streams with a watermark and on tables."""
    burst = changes.groupBy(key, F.session_window(ts, gap).alias("burst")).agg(F.max_by(value, ts).alias(value), F.count("*").alias("n"))
    return burst.select(key, F.col("burst.start").alias("start"), F.col("burst.end").alias("end"), value, "n")


def debounced_batch(changes: DataFrame, key: str, ts: str, gap_seconds: int, order: list[str]) -> DataFrame:
    """Changes that none of the same key follows within the gap."""
    nxt = F.lead(ts).over(Window.partitionBy(key).orderBy(ts, *order))
    return changes.withColumn("_n", nxt).where(F.col("_n").isNull() | (F.unix_micros(F.col("_n").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")) > gap_seconds * 1_000_000)).drop("_n")


def fingerprint_changes(rows: DataFrame, key: str, order: list[str], fingerprint: str) -> DataFrame:
    """Batch twin of ``fingerprint_stream``: first_seen, unchanged or changed for each version of a key, in order."""
    before = F.lag(fingerprint).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("verdict", F.when(before.isNull(), "first_seen").when(before == F.col(fingerprint), "unchanged").otherwise("changed"))


def _verdicts(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (last,) = state.get if state.exists else (None,)
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    out = []
    for seq, fp in zip(rows["seq"], rows["fingerprint"], strict=True):
        out.append((key[0], seq, "first_seen" if last is None else "unchanged" if last == fp else "changed"))
        last = fp
    state.update((last,))
    yield pd.DataFrame(out, columns=["key", "seq", "verdict"])


def fingerprint_stream(changes: DataFrame) -> DataFrame:
    """key, seq, verdict for a stream of (key long, seq long, fingerprint string): the last fingerprint of each key is its state."""
    return changes.groupBy("key").applyInPandasWithState(_verdicts, "key long, seq long, verdict string", "last string", "append", GroupStateTimeout.NoTimeout)


def _current(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (top,) = state.get if state.exists else (-(2**63),)
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    out = []
    for seq, gen in zip(rows["seq"], rows["generation"], strict=True):
        if gen >= top:
            out.append((key[0], seq, gen))
            top = gen
    state.update((int(top),))
    yield pd.DataFrame(out, columns=["key", "seq", "generation"])


def current_stream(changes: DataFrame) -> DataFrame:
    """Events of a stream (key, seq, generation long) whose generation is not older than one already seen of their key."""
    return changes.groupBy("key").applyInPandasWithState(_current, "key long, seq long, generation long", "top long", "append", GroupStateTimeout.NoTimeout)


def current_batch(rows: DataFrame, key: str, order: list[str], generation: str) -> DataFrame:
    """Batch twin of ``current_stream``: ties are accepted."""
    top = F.max(generation).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_top", top).where(F.col("_top").isNull() | (F.col(generation) >= F.col("_top"))).drop("_top")


def reconcile(backfill: DataFrame, queued: DataFrame, key: str, generation: str) -> DataFrame:
    """A bulk load and the changes that came meanwhile, each (key, generation) once, the newest of each key kept."""
    rest = [c for c in backfill.columns if c != key]
    both = backfill.unionByName(queued).dropDuplicates([key, generation])
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), generation).alias("x")).select(key, "x.*")


def single_flight(requests: DataFrame, key: str, order: str) -> DataFrame:
    """One request per key, the earliest; with how many it answers."""
    return requests.groupBy(key).agg(F.min(order).alias(order), F.count("*").alias("answers"))


def maintain(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run apply on each micro-batch of a stream until it is drained; apply has to be idempotent per batch number."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_batch(path: str, key: str, generation: str) -> Callable[[DataFrame, int], None]:
    """An apply for ``maintain``: each batch's newest row per key is appended under its batch number; a replay overwrites it.

    ``latest`` reads the result, so that a batch costs what it changes, not what there is.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != key]
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*rest), generation).alias("x")).select(key, "x.*")
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return apply


def latest(spark: SparkSession, path: str, key: str, generation: str) -> DataFrame:
    """The newest row of each key over all batches of ``upsert_batch``."""
    rows = spark.read.parquet(path).drop("batch")
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), generation).alias("x")).select(key, "x.*")


def flush(edges: DataFrame, answers: DataFrame, changed: DataFrame, evaluate: Callable[[DataFrame, DataFrame], DataFrame], max_rounds: int = 8) -> tuple[DataFrame, bool]:
    """Re-evaluate what changed keys reach, round by round, and stop where evaluated answers do not move.

    edges (src, dst): dst reads src. answers (key, answer). evaluate takes the keys to derive (key) and all answers, and
    returns (key, answer) for those keys: a round costs what its frontier reaches. Returns the new answers and whether the rounds converged; a caller publishes only convergent ones.
    """
    from factloom.operators.graph import cut

    frontier = changed.select("key").distinct()
    for _ in range(max_rounds):
        readers = edges.join(frontier.select(F.col("key").alias("src")), "src", "left_semi").select(F.col("dst").alias("key")).distinct()
        new = evaluate(readers, answers).withColumnRenamed("answer", "now")
        moved = cut(new.join(answers, "key", "left").where(~F.col("now").eqNullSafe(F.col("answer"))).select("key", "now"))
        if moved.isEmpty():
            return answers, True
        answers = cut(answers.join(moved, "key", "full_outer").select("key", F.coalesce("now", "answer").alias("answer")))
        frontier = moved.select("key")
    return answers, False
