"""Queries over positions: lines of an order as spans, events as facts in time, turns as scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from factloom.operators import spans as S
from factloom.plans.registry import register
from factloom.sources.facts import table

BODY_SQL = "body AS (SELECT o_custkey AS file, o_orderkey AS body, o_orderkey % 50 AS start, o_orderkey % 50 + o_orderkey % 13 AS \"end\" FROM orders)"
POINT_SQL = "pt AS (SELECT o_custkey AS file, l_linenumber, l_orderkey, l_partkey % 60 AS pos FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("o_orderkey") % 50
    return table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("body"), start.alias("start"), (start + F.col("o_orderkey") % 13).alias("end"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("file"))
    return table(spark, d, "lineitem").join(o, "l_orderkey").select("file", "l_orderkey", "l_linenumber", (F.col("l_partkey") % 60).alias("pos"))


@register("range_containment", f"WITH {BODY_SQL}, {POINT_SQL} SELECT body, count(*) AS n FROM body JOIN pt ON body.file = pt.file AND pos >= start AND pos <= \"end\" GROUP BY body")
def range_containment(spark: SparkSession, d: str) -> DataFrame:
    """References inside each body."""
    return S.contained(_points(spark, d), _bodies(spark, d), ["file"], 16).groupBy("body").agg(F.count("*").alias("n"))


@register("innermost_scope", f"WITH {BODY_SQL}, {POINT_SQL} SELECT pt.l_orderkey, l_linenumber, pos, arg_min(body, (\"end\" - start, start, body)) AS body FROM body JOIN pt ON body.file = pt.file AND pos >= start AND pos <= \"end\" GROUP BY pt.l_orderkey, l_linenumber, pos")
def innermost_scope(spark: SparkSession, d: str) -> DataFrame:
    return S.innermost(_points(spark, d), _bodies(spark, d), ["file"], ["l_orderkey", "l_linenumber", "pos"], 16, "body")


@register("package_at_point", f"WITH {BODY_SQL}, {POINT_SQL} SELECT pt.l_orderkey, l_linenumber, pos, arg_max(body, (start, body)) AS body FROM body JOIN pt ON body.file = pt.file AND pos >= start AND pos <= \"end\" GROUP BY pt.l_orderkey, l_linenumber, pos")
def package_at_point(spark: SparkSession, d: str) -> DataFrame:
    """The containing range that starts last."""
    return S.latest_start(_points(spark, d), _bodies(spark, d), ["file"], ["l_orderkey", "l_linenumber", "pos"], 16, "body")


@register("asof_type_at_point", "WITH f AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase') SELECT e.event_id, (SELECT arg_max(f.value, (f.ts, f.event_id)) FROM f WHERE f.user_id = e.user_id AND (f.ts, f.event_id) <= (e.ts, e.event_id)) AS value FROM events e WHERE event_type = 'view'")
def asof_type_at_point(spark: SparkSession, d: str) -> DataFrame:
    """The latest fact at or before each point."""
    e = table(spark, d, "events")
    facts = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    return S.as_of(e.where("event_type = 'view'").select("user_id", "ts", "event_id"), facts, ["user_id"], ["ts", "event_id"], "value").select("event_id", "value")


@register("overlap_anti", f"WITH {BODY_SQL} SELECT body FROM body a WHERE body % 2 = 0 AND NOT EXISTS (SELECT 1 FROM body b WHERE b.body % 2 = 1 AND b.file = a.file AND a.start < b.\"end\" AND b.start < a.\"end\")")
def overlap_anti(spark: SparkSession, d: str) -> DataFrame:
    b = _bodies(spark, d)
    return S.overlap_free(b.where("body % 2 = 0"), b.where("body % 2 = 1"), ["file"], 16).select("body")


EV_SQL = "v AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'read' WHEN 'purchase' THEN 'move' ELSE 'write' END AS event FROM events)"


@register("use_after_move", f"WITH {EV_SQL}, s AS (SELECT *, last_value(CASE WHEN event <> 'read' THEN event END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM v) SELECT user_id, event_id FROM s WHERE event = 'read' AND st = 'move'")
def use_after_move(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "click"), "read").when(F.col("event_type") == "purchase", "move").otherwise("write")
    e = table(spark, d, "events").select("user_id", "ts", "event_id", kind.alias("event"))
    return S.after_move(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@register("first_rebind", f"WITH {BODY_SQL}, {POINT_SQL} SELECT body, coalesce(min(pos), any_value(\"end\")) AS stop FROM body LEFT JOIN pt ON body.file = pt.file AND pos >= start AND pos <= \"end\" GROUP BY body")
def first_rebind(spark: SparkSession, d: str) -> DataFrame:
    """Where the first write inside a region cuts it off."""
    return S.first_rebind(_bodies(spark, d), _points(spark, d).select("file", "pos"), ["file"], 16).groupBy("body").agg(F.min("stop").alias("stop"))


@register("latest_wins_at_point", "SELECT c.conv_id, c.turn, (SELECT arg_max(u.text, u.turn) FROM conversations u WHERE u.conv_id = c.conv_id AND u.role = 'user' AND u.turn <= c.turn) AS text FROM conversations c WHERE role = 'assistant'")
def latest_wins_at_point(spark: SparkSession, d: str) -> DataFrame:
    """The last user text in force at each answer."""
    c = table(spark, d, "conversations")
    return S.as_of(c.where("role = 'assistant'").select("conv_id", "turn"), c.where("role = 'user'").select("conv_id", "turn", "text"), ["conv_id"], ["turn"], "text")


@register("scope_chain_lookup", "WITH a AS (SELECT s_suppkey, 0 AS depth, CASE WHEN s_acctbal > 8000 THEN 'Class:S' WHEN s_acctbal > 4000 THEN 'HashRef' END AS type FROM supplier UNION ALL SELECT s_suppkey, 1, CASE WHEN s_nationkey % 3 = 0 THEN 'Class:N' WHEN s_nationkey % 3 = 1 THEN 'ArrayRef' END FROM supplier UNION ALL SELECT s_suppkey, 2, 'String' FROM supplier) SELECT s_suppkey, coalesce(arg_min(type, depth) FILTER (starts_with(type, 'Class:')), arg_min(type, depth) FILTER (type IS NOT NULL)) AS type FROM a GROUP BY s_suppkey")
def scope_chain_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Innermost strong answer along a scope chain, else the innermost weak one."""
    s = table(spark, d, "supplier")
    at = lambda depth, t: s.select("s_suppkey", F.lit(depth).alias("depth"), t.alias("type"))
    n = F.col("s_nationkey") % 3
    a = at(0, F.when(F.col("s_acctbal") > 8000, "Class:S").when(F.col("s_acctbal") > 4000, "HashRef")).unionByName(at(1, F.when(n == 0, "Class:N").when(n == 1, "ArrayRef"))).unionByName(at(2, F.lit("String")))
    strong = F.min_by("type", F.when(F.col("type").startswith("Class:"), F.col("depth")))
    return a.groupBy("s_suppkey").agg(F.coalesce(strong, F.min_by("type", F.when(F.col("type").isNotNull(), F.col("depth")))).alias("type"))


@register("offset_remap", f"WITH {BODY_SQL}, {POINT_SQL} SELECT pt.l_orderkey, l_linenumber, pos + coalesce((SELECT sum(CAST(b.body % 13 AS INT)) FROM body b WHERE b.file = pt.file AND b.start < pos), 0)::BIGINT AS original FROM pt")
def offset_remap(spark: SparkSession, d: str) -> DataFrame:
    """Positions in a transformed text back to the original: plus all splices before them, as a running sum over both sides."""
    splices = _bodies(spark, d).select("file", F.col("start").alias("pos"), (F.col("end") - F.col("start")).alias("shift"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("l_orderkey"), F.lit(None).cast("int").alias("l_linenumber"))
    points = _points(spark, d).select("file", "pos", F.lit(0).cast("long").alias("shift"), F.lit(0).alias("side"), "l_orderkey", "l_linenumber")
    w = Window.partitionBy("file").orderBy("pos", "side").rowsBetween(Window.unboundedPreceding, -1)
    both = splices.unionByName(points).withColumn("before", F.coalesce(F.sum("shift").over(w), F.lit(0)))
    return both.where("side = 0").select("l_orderkey", "l_linenumber", (F.col("pos") + F.col("before")).alias("original"))
