"""Batch twins of the incremental rules, and the streams themselves drained into a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.plans.registry import register
from factloom.session import shared_folder
from factloom.sources.facts import table
from factloom.streaming import changes as C


@register("debounce_latest", "SELECT user_id, event_id FROM events QUALIFY lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) > 21600000000")
def debounce_latest(spark: SparkSession, d: str) -> DataFrame:
    """Events that nothing of the same user follows within six hours."""
    return C.debounced_batch(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", 6 * 3600, ["event_id"]).select("user_id", "event_id")


@register("session_gap", "WITH s AS (SELECT user_id, ts, value, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS \"end\", arg_max(value, ts) AS value, count(*) AS n FROM g GROUP BY user_id, g")
def session_gap(spark: SparkSession, d: str) -> DataFrame:
    return C.debounce(table(spark, d, "events").select("user_id", "ts", "value"), "user_id", "ts", "6 hours", "value")


FP_SQL = "SELECT user_id AS key, event_id AS seq, sha256(CAST(CAST(floor(value / 20) AS INT) AS VARCHAR)) AS fingerprint FROM events"


def _versions(spark: SparkSession, d: str) -> DataFrame:
    fp = F.sha2(F.floor(F.col("value") / 20).cast("int").cast("string"), 256)
    return table(spark, d, "events").select(F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("long").alias("seq"), fp.alias("fingerprint"))


@register("fingerprint_changes", f"WITH f AS ({FP_SQL}), l AS (SELECT *, lag(fingerprint) OVER (PARTITION BY key ORDER BY seq) AS b FROM f) SELECT key, seq, CASE WHEN b IS NULL THEN 'first_seen' WHEN b = fingerprint THEN 'unchanged' ELSE 'changed' END AS verdict FROM l")
def fingerprint_changes(spark: SparkSession, d: str) -> DataFrame:
    return C.fingerprint_changes(_versions(spark, d), "key", ["seq"], "fingerprint").select("key", "seq", "verdict")


@register("stale_gen_reject", "WITH g AS (SELECT user_id AS key, event_id AS seq, event_id // 10 + CAST(floor(value) AS INT) % 50 AS generation FROM events), t AS (SELECT *, max(generation) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM g) SELECT key, seq, generation FROM t WHERE top IS NULL OR generation >= top")
def stale_gen_reject(spark: SparkSession, d: str) -> DataFrame:
    return C.current_batch(_generations(spark, d), "key", ["seq"], "generation")


def _generations(spark: SparkSession, d: str) -> DataFrame:
    gen = F.floor(F.col("event_id") / 10) + F.floor("value").cast("int") % 50
    return table(spark, d, "events").select(F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("long").alias("seq"), gen.cast("long").alias("generation"))


@register("reconcile_backfill", "WITH b AS (SELECT user_id AS key, event_id AS generation, value FROM events WHERE event_id % 3 <> 0 UNION SELECT user_id, event_id, value FROM events WHERE event_id % 2 = 0) SELECT key, max(generation) AS generation, arg_max(value, generation) AS value FROM b GROUP BY key")
def reconcile_backfill(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("generation"), "value")
    return C.reconcile(e.where("generation % 3 <> 0"), e.where("generation % 2 = 0"), "key", "generation")


@register("single_flight", "SELECT user_id, min(event_id) AS event_id, count(*) AS answers FROM events GROUP BY user_id")
def single_flight(spark: SparkSession, d: str) -> DataFrame:
    return C.single_flight(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


@register("enrichment_keys", "SELECT c_nationkey, sha256(string_agg(c_custkey || ':' || c_mktsegment, '|' ORDER BY c_custkey)) AS key FROM customer GROUP BY c_nationkey")
def enrichment_keys(spark: SparkSession, d: str) -> DataFrame:
    """A view's key: the sorted fingerprints of everything it reads."""
    parts = F.array_sort(F.collect_list(F.struct("c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit(":"), "c_mktsegment").alias("x"))))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.sha2(F.array_join(F.transform(parts, lambda p: p["x"]), "|"), 256).alias("key"))


def _drain(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a stream until what it has is read, into Parquet in the shared folder."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@register("stream_fingerprint", f"WITH f AS ({FP_SQL}), l AS (SELECT *, lag(fingerprint) OVER (PARTITION BY key ORDER BY seq) AS b FROM f) SELECT key, seq, CASE WHEN b IS NULL THEN 'first_seen' WHEN b = fingerprint THEN 'unchanged' ELSE 'changed' END AS verdict FROM l")
def stream_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """The change detector as a stream, with a fingerprint per key as its state."""
    fp = F.sha2(F.floor(F.col("value") / 20).cast("int").cast("string"), 256)
    return _drain(spark, C.fingerprint_stream(_event_stream(spark, d).select(F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("long").alias("seq"), fp.alias("fingerprint"))))


@register("stream_current", "WITH g AS (SELECT user_id AS key, event_id AS seq, event_id // 10 + CAST(floor(value) AS INT) % 50 AS generation FROM events), t AS (SELECT *, max(generation) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM g) SELECT key, seq, generation FROM t WHERE top IS NULL OR generation >= top")
def stream_current(spark: SparkSession, d: str) -> DataFrame:
    """Stale generations dropped as they come."""
    gen = F.floor(F.col("event_id") / 10) + F.floor("value").cast("int") % 50
    return _drain(spark, C.current_stream(_event_stream(spark, d).select(F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("long").alias("seq"), gen.cast("long").alias("generation"))))


@register("stream_debounce")
def stream_debounce(spark: SparkSession, d: str) -> DataFrame:
    """Closed bursts of a stream under a watermark; the tests hold them against the batch twin."""
    e = _event_stream(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value").withWatermark("ts", "1 hour")
    return _drain(spark, C.debounce(e, "user_id", "ts", "6 hours", "value"))
