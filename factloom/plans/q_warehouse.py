"""Queries of the measurement warehouse; runs are days, corpora are event types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from factloom.operators import warehouse as W
from factloom.plans.registry import register
from factloom.sources.facts import table

M_SQL = "m AS (SELECT event_type AS corpus, date_trunc('day', ts)::DATE AS run, CASE WHEN hour(ts) < 12 THEN 'cold' ELSE 'warm' END AS phase, user_id, event_id, value FROM events)"


def measurements(spark: SparkSession, d: str) -> DataFrame:
    phase = F.when(F.hour("ts") < 12, "cold").otherwise("warm")
    return table(spark, d, "events").select(F.col("event_type").alias("corpus"), F.to_date("ts").alias("run"), phase.alias("phase"), "user_id", "event_id", "value")


@register("bench_headline", f"WITH {M_SQL} SELECT corpus, phase, user_id, count(*) AS n, median(value) AS median, min(value) AS min, max(value) AS max, max(value) - min(value) AS spread, CASE WHEN count(*) < 3 THEN 'PROVISIONAL (n<3)' END AS caveat FROM m GROUP BY ALL")
def bench_headline(spark: SparkSession, d: str) -> DataFrame:
    return W.headline(measurements(spark, d), ["corpus", "phase", "user_id"])


@register("bench_quantiles", f"WITH {M_SQL} SELECT corpus, round(sum(value), 4) AS total, median(value) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max, round(max(value) / nullif(median(value), 0), 6) AS max_over_p50 FROM m GROUP BY corpus")
def bench_quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = W.quantiles(measurements(spark, d), ["corpus"])
    return q.select("corpus", F.round("total", 4).alias("total"), "p50", F.round("p99", 6).alias("p99"), "max", F.round("max_over_p50", 6).alias("max_over_p50"))


@register("bench_pivot", f"WITH {M_SQL} SELECT corpus, run, median(CASE WHEN phase = 'cold' THEN value END) AS cold, median(CASE WHEN phase = 'warm' THEN value END) AS warm FROM m GROUP BY corpus, run HAVING median(CASE WHEN phase = 'cold' THEN value END) IS DISTINCT FROM median(CASE WHEN phase = 'warm' THEN value END)")
def bench_pivot(spark: SparkSession, d: str) -> DataFrame:
    return W.pivot_medians(measurements(spark, d), ["corpus", "run"], F.col("phase"), ("cold", "warm"))


SERIES_SQL = f"{M_SQL}, s AS (SELECT corpus, run AS ts, median(value) AS med, max(value) - min(value) AS spread, count(*) AS n FROM m GROUP BY corpus, run)"


def _series(spark: SparkSession, d: str) -> DataFrame:
    return measurements(spark, d).groupBy("corpus", F.col("run").alias("ts")).agg(F.median("value").alias("med"), (F.max("value") - F.min("value")).alias("spread"), F.count("*").alias("n"))


@register("bench_regression_lag", f"WITH {SERIES_SQL}, l AS (SELECT *, lag(med) OVER w AS prev_med, lag(spread) OVER w AS prev_spread, lag(n) OVER w AS prev_n FROM s WINDOW w AS (PARTITION BY corpus ORDER BY ts)) SELECT *, abs(med - prev_med) > greatest(spread, prev_spread, 1.0) AS flag FROM l")
def bench_regression_lag(spark: SparkSession, d: str) -> DataFrame:
    return W.regressions(_series(spark, d), ["corpus"])


@register(
    "bench_baseline_check",
    f"""WITH {SERIES_SQL}, f AS (SELECT corpus, med AS value, spread FROM s WHERE ts = (SELECT max(ts) FROM s)), b AS (SELECT corpus, min(med) AS base, min(spread) / 1000 AS base_spread FROM s GROUP BY corpus)
    SELECT corpus, value, spread, base, base_spread, CASE WHEN value > base * 1.1 AND value - base > greatest(spread, base_spread) THEN 'REGRESSED' WHEN value * 1.1 < base AND base - value > greatest(spread, base_spread) THEN 'improved' ELSE 'ok' END AS verdict FROM f JOIN b USING (corpus)""",
)
def bench_baseline_check(spark: SparkSession, d: str) -> DataFrame:
    s = _series(spark, d)
    newest = s.agg(F.max("ts").alias("ts"))
    fresh = s.join(F.broadcast(newest), "ts").select("corpus", F.col("med").alias("value"), "spread")  # one row
    base = s.groupBy("corpus").agg(F.min("med").alias("base"), (F.min("spread") / 1000).alias("base_spread"))
    return W.baseline_check(fresh, base, ["corpus"])


@register("baseline_append", f"WITH {M_SQL} SELECT corpus, phase, median(value) AS median, list_sort(list(value))[least(count(*), floor(count(*) * 0.99)::INT + 1)] AS p99, max(value) AS max, count(*) AS n FROM m GROUP BY corpus, phase")
def baseline_append(spark: SparkSession, d: str) -> DataFrame:
    """Baseline rows with the nearest-rank p99, by position in each group's order."""
    m = measurements(spark, d)
    ranked = m.withColumn("r", F.row_number().over(Window.partitionBy("corpus", "phase").orderBy("value")))
    sizes = m.groupBy("corpus", "phase").agg(F.count("*").alias("n"), F.median("value").alias("median"), F.max("value").alias("max"))
    at = F.least(F.col("n"), F.floor(F.col("n") * 0.99) + 1)
    return ranked.join(F.broadcast(sizes), ["corpus", "phase"]).where(F.col("r") == at).select("corpus", "phase", "median", F.col("value").alias("p99"), "max", "n")  # a row per baseline


@register("nearest_rank_p99", "SELECT user_id, list_sort(list(value))[least(count(*), floor(count(*) * 0.99)::INT + 1)] AS p99 FROM events GROUP BY user_id")
def nearest_rank_p99(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(W.nearest_rank(F.collect_list("value"), 0.99).alias("p99"))


@register("trustworthy_runs", "SELECT user_id, count(*) AS n FROM events WHERE NOT (event_id % 3 = 0) AND value < 2.0 GROUP BY user_id")
def trustworthy_runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", (F.col("event_id") % 3 == 0).alias("dirty"), F.col("value").alias("loadavg_at_start"))
    return W.trustworthy(e).groupBy("user_id").agg(F.count("*").alias("n"))


@register("bench_top_movers", f"WITH {SERIES_SQL} SELECT corpus, ts, med FROM s ORDER BY med DESC, corpus, ts LIMIT 15")
def bench_top_movers(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d).select("corpus", "ts", "med").orderBy(F.desc("med"), "corpus", "ts").limit(15)


@register("measurement_run_join", f"WITH {M_SQL}, r AS (SELECT run, min(event_id) AS first_id FROM m GROUP BY run) SELECT corpus, m.run, count(*) AS n, min(first_id) AS first_id FROM m JOIN r USING (run) GROUP BY corpus, m.run")
def measurement_run_join(spark: SparkSession, d: str) -> DataFrame:
    m = measurements(spark, d)
    runs = m.groupBy("run").agg(F.min("event_id").alias("first_id"))
    return m.join(runs, "run").groupBy("corpus", "run").agg(F.count("*").alias("n"), F.min("first_id").alias("first_id"))


ANSWERS_SQL = """b AS (SELECT o_custkey AS pos, list_sort(list(DISTINCT o_orderpriority)) AS base FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey),
h AS (SELECT o_custkey AS pos, list_sort(list(DISTINCT o_orderpriority)) AS head FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey),
c AS (SELECT pos, CASE WHEN coalesce(len(base), 0) = 0 AND coalesce(len(head), 0) = 0 THEN 'both_empty' WHEN coalesce(len(base), 0) = 0 THEN 'only_head' WHEN coalesce(len(head), 0) = 0 THEN 'only_base'
  WHEN list_has_all(head, base) AND list_has_all(base, head) THEN 'equal' WHEN list_has_all(head, base) THEN 'superset' WHEN list_has_all(base, head) THEN 'subset' WHEN list_has_any(base, head) THEN 'overlap' ELSE 'disagree' END AS shape FROM b FULL JOIN h USING (pos))"""


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    answers = lambda x: x.groupBy(F.col("o_custkey").alias("pos")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias("answer"))
    return W.compare_answers(answers(o.where("o_orderkey % 2 = 0")), answers(o.where("o_orderkey % 3 <> 0")), ["pos"])


@register("ab_classify_full_outer", f"WITH {ANSWERS_SQL} SELECT pos, shape FROM c")
def ab_classify_full_outer(spark: SparkSession, d: str) -> DataFrame:
    return _shapes(spark, d).select("pos", "shape")


@register("shape_histogram", f"WITH {ANSWERS_SQL} SELECT shape, pos % 5 AS verb, count(*) AS n FROM c GROUP BY ALL")
def shape_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _shapes(spark, d).groupBy("shape", (F.col("pos") % 5).alias("verb")).agg(F.count("*").alias("n"))


@register("noise_floor", f"WITH {ANSWERS_SQL}, n AS (SELECT shape, pos % 5 AS verb, count(*) AS n FROM c GROUP BY ALL) SELECT shape, max(n) AS floor, min(n) AS low FROM n GROUP BY shape")
def noise_floor(spark: SparkSession, d: str) -> DataFrame:
    """Largest and smallest count of a shape over run pairs."""
    return shape_histogram(spark, d).groupBy("shape").agg(F.max("n").alias("floor"), F.min("n").alias("low"))


@register("representatives", f"WITH {ANSWERS_SQL} SELECT shape, pos FROM c QUALIFY row_number() OVER (PARTITION BY shape ORDER BY pos) <= 3")
def representatives(spark: SparkSession, d: str) -> DataFrame:
    """Three examples of each shape; Spark cuts each task's rows to the limit before the shuffle."""
    w = Window.partitionBy("shape").orderBy("pos")
    return _shapes(spark, d).select("shape", "pos", F.row_number().over(w).alias("r")).where("r <= 3").select("shape", "pos")


@register("completeness", "SELECT user_id, count(*) AS declared, count(*) FILTER (value > 1) AS answered, round(count(*) FILTER (value > 1) / count(*), 6) AS share FROM events GROUP BY user_id")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("declared"), F.count_if(F.col("value") > 1).alias("answered"), F.round(F.count_if(F.col("value") > 1) / F.count("*"), 6).alias("share"))


@register("noise_pairs", f"WITH {M_SQL}, r AS (SELECT run, round(sum(value), 4) AS total FROM m GROUP BY run) SELECT a.run AS run_a, b.run AS run_b, abs(a.total - b.total) > 50 AS differs FROM r a JOIN r b ON a.run < b.run")
def noise_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of runs: a bounded table of runs, never of measurements."""
    r = measurements(spark, d).groupBy("run").agg(F.round(F.sum("value"), 4).alias("total"))
    a, b = r.select(F.col("run").alias("run_a"), F.col("total").alias("x")), r.select(F.col("run").alias("run_b"), F.col("total").alias("y"))
    return a.join(b, F.col("run_a") < F.col("run_b")).select("run_a", "run_b", (F.abs(F.col("x") - F.col("y")) > 50).alias("differs"))


@register("heap_rollup", "SELECT p_brand, p_size, sum(p_partkey)::BIGINT AS bytes FROM part GROUP BY ROLLUP (p_brand, p_size)")
def heap_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").rollup("p_brand", "p_size").agg(F.sum("p_partkey").alias("bytes"))


@register("exclusive_time", "SELECT o_orderkey AS id, round(o_totalprice - coalesce(sum(l_quantity), 0), 3) AS own_ns FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice")
def exclusive_time(spark: SparkSession, d: str) -> DataFrame:
    """Each span less its children."""
    top = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("long").alias("parent"), F.col("o_totalprice").alias("ns"))
    inner = table(spark, d, "lineitem").select(F.lit(-1).cast("long").alias("id"), F.col("l_orderkey").alias("parent"), F.col("l_quantity").alias("ns"))
    return W.exclusive_time(top.unionByName(inner)).where("id >= 0").select("id", F.round("own_ns", 3).alias("own_ns"))


@register("ghost_statistics", "SELECT user_id, count(*) AS refetches FROM events GROUP BY user_id ORDER BY refetches DESC, user_id LIMIT 20")
def ghost_statistics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("refetches")).orderBy(F.desc("refetches"), "user_id").limit(20)
