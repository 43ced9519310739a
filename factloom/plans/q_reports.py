"""The heatmap, dead exports, samples and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators import reports, sampling
from factloom.operators.graph import cut
from factloom.plans.registry import register
from factloom.sources import facts
from factloom.sources.facts import SYMS_SQL, table

HEAT_SQL = f"""{SYMS_SQL}, u AS (SELECT file_id, key, count(*) AS n FROM occ GROUP BY file_id, key),
v AS (SELECT u.file_id, u.key, u.n - CASE WHEN s.key IS NOT NULL THEN 1 ELSE 0 END AS n FROM u LEFT JOIN syms s USING (file_id, key)),
t AS (SELECT key, sum(n) AS all_uses FROM v GROUP BY key), dyn AS (SELECT sum(toxic) > 0 AS d FROM labels),
h AS (SELECT s.file_id, s.key, s.kind, s.start_at, coalesce(t.all_uses, 0)::BIGINT AS fan_in, (coalesce(t.all_uses, 0) - coalesce(v.n, 0))::BIGINT AS cross_file_fan_in, (s.flags & 8) <> 0 AS exported
 FROM syms s LEFT JOIN t USING (key) LEFT JOIN v ON v.file_id = s.file_id AND v.key = s.key),
g AS (SELECT *, CASE WHEN fan_in > 0 THEN NULL WHEN exported THEN 'exported' WHEN key = 'new' THEN 'constructor' WHEN kind IN (1, 2) AND key = 'main' THEN 'entry-point' WHEN kind IN (3, 4, 5) THEN 'package-implicit-use' WHEN d AND kind IN (1, 2) AND start_at % 2 = 0 THEN 'dynamic-dispatch' END AS reachable_guard FROM h, dyn)"""


def _heat(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of labelled documents as symbols; each file's first occurrence of its own symbol is the declaration, no use."""
    sites = cut(facts.occurrences(spark, d).groupBy("file_id", "key").agg(F.count("*").alias("n"), F.min("pos").alias("start_at")))  # texts are split once
    marked = sites.join(facts.declaring(spark, d), "file_id", "left")
    marked = marked.withColumn("n", F.col("n") - F.col("kind").isNotNull().cast("long"))
    # dynamic dispatch anywhere in the corpus shields every other symbol, by position: one value
    shielded = bool(table(spark, d, "labels").agg(F.sum("toxic") > 0).first()[0])
    return reports.heatmap_of_sites(marked, F.lit(shielded) & (F.col("start_at") % 2 == 0))


COLUMNS = ["file_id", "key", "kind", "start_at", "fan_in", "cross_file_fan_in", "exported", "reachable_guard", "dead_code_candidate", "dead_export"]


@register("heatmap", f"WITH {HEAT_SQL} SELECT file_id, key, kind, start_at, fan_in, cross_file_fan_in, exported, reachable_guard, fan_in = 0 AND reachable_guard IS NULL AS dead_code_candidate, kind IN (1, 2) AND exported AND cross_file_fan_in = 0 AS dead_export FROM g")
def heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Uses, dead code and dead exports of every symbol: the flagship report."""
    return _heat(spark, d).select(*COLUMNS)


@register("dead_exports", f"WITH {HEAT_SQL} SELECT file_id, key FROM g WHERE kind IN (1, 2) AND exported AND cross_file_fan_in = 0")
def dead_exports(spark: SparkSession, d: str) -> DataFrame:
    return _heat(spark, d).where("dead_export").select("file_id", "key")


@register("guard_histogram", f"WITH {HEAT_SQL} SELECT coalesce(reachable_guard, CASE WHEN fan_in = 0 THEN 'dead' ELSE 'used' END) AS state, count(*) AS n FROM g GROUP BY ALL")
def guard_histogram(spark: SparkSession, d: str) -> DataFrame:
    state = F.coalesce("reachable_guard", F.when(F.col("fan_in") == 0, "dead").otherwise("used"))
    return _heat(spark, d).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@register("call_heatmap", "WITH i AS (SELECT l_partkey AS callee, count(*) AS fan_in, count(DISTINCT l_suppkey) AS callers, count(*) FILTER (l_suppkey <> l_partkey % 100) AS cross_file_fan_in FROM lineitem GROUP BY l_partkey) SELECT p_partkey, p_name, coalesce(fan_in, 0) AS fan_in, coalesce(callers, 0) AS callers, coalesce(cross_file_fan_in, 0) AS cross_file_fan_in FROM part LEFT JOIN i ON callee = p_partkey")
def call_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Fan-in of every part over its call sites."""
    i = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("fan_in"), F.count_distinct("l_suppkey").alias("callers"), F.count_if(F.col("l_suppkey") != F.col("l_partkey") % 100).alias("cross_file_fan_in"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return table(spark, d, "part").select("p_partkey", "p_name").join(i, "p_partkey", "left").select("p_partkey", "p_name", zero("fan_in"), zero("callers"), zero("cross_file_fan_in"))


@register("fan_out", "SELECT l_suppkey AS caller, count(DISTINCT l_partkey) FILTER (l_partkey <> l_suppkey) AS fan_out FROM lineitem GROUP BY l_suppkey")
def fan_out(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("caller")).agg(F.count_distinct(F.when(F.col("l_partkey") != F.col("l_suppkey"), F.col("l_partkey"))).alias("fan_out"))


@register("heatmap_top", "SELECT l_partkey, count(*) AS fan_in FROM lineitem GROUP BY l_partkey ORDER BY fan_in DESC, l_partkey LIMIT 25")
def heatmap_top(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("fan_in")).orderBy(F.desc("fan_in"), "l_partkey").limit(25)


SHARE_SQL = "('0x' || substr(sha256(concat_ws(chr(0), 'seed', {})), 1, 12))::BIGINT / 281474976710656.0"


@register("hash_sample", f"SELECT event_id FROM events WHERE {SHARE_SQL.format('event_id')} < 0.15")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.hash_sample(table(spark, d, "events"), [F.lit("seed"), F.col("event_id").cast("string")], F.lit(0.15)).select("event_id")


@register("stratified_cap", f"WITH s AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY {SHARE_SQL.format('event_id')}) AS r FROM events), t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r, event_type) AS t FROM s) SELECT user_id, event_type, event_id FROM t WHERE t <= 12")
def stratified_cap(spark: SparkSession, d: str) -> DataFrame:
    from factloom.functions.names import hash_share

    return sampling.round_robin_cap(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_type", hash_share(F.lit("seed"), F.col("event_id").cast("string")), 12)


@register("topk_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    return sampling.top_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@register("completion_rank_cap", "WITH c AS (SELECT p_name AS label, p_partkey, p_size % 7 AS priority FROM part WHERE starts_with(p_name, 's')) SELECT label, p_partkey, priority, (SELECT count(*) FROM c) > 200 AS incomplete FROM c ORDER BY priority, label, p_partkey LIMIT 200")
def completion_rank_cap(spark: SparkSession, d: str) -> DataFrame:
    """Rank, then cut, with a flag that there was more."""
    c = table(spark, d, "part").where(F.col("p_name").startswith("s")).select(F.col("p_name").alias("label"), "p_partkey", (F.col("p_size") % 7).alias("priority"))
    return sampling.ranked_cut(c, [F.col("priority"), F.col("label"), F.col("p_partkey")], 200)


@register("rank_by_expected_type", "SELECT p_partkey, p_type = 'SMALL' AS match FROM part ORDER BY p_type = 'SMALL' DESC, p_partkey LIMIT 50")
def rank_by_expected_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", (F.col("p_type") == "SMALL").alias("match")).orderBy(F.desc("match"), "p_partkey").limit(50)


@register("sorted_locations", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def sorted_locations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates().orderBy("l_orderkey", "l_linenumber")


@register("priority_rank_cap", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CAST(substr(o_orderpriority, 1, 1) AS INT), o_orderkey LIMIT 100")
def priority_rank_cap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority").orderBy(F.substring("o_orderpriority", 1, 1).cast("int"), "o_orderkey").limit(100)


@register("severity_filter", "SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'view' THEN 'info' ELSE 'hint' END AS severity FROM events WHERE event_type IN ('error', 'purchase')")
def severity_filter(spark: SparkSession, d: str) -> DataFrame:
    from factloom.functions.names import severity_rank

    t = F.col("event_type")
    e = table(spark, d, "events").select("event_id", F.when(t == "error", "error").when(t == "purchase", "warning").when(t == "view", "info").otherwise("hint").alias("severity"))
    return e.where(severity_rank(F.col("severity")) <= 1)
