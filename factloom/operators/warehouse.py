"""The measurement warehouse: headline statistics, quantiles, pivots, regressions, baselines and answer comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.model import IMPROVED, PROVISIONAL, REGRESSED, UNCHANGED


def load(spark, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(runs, measurements) of a warehouse of JSON lines, split by the field t; bad lines are skipped, columns united."""
    rows = spark.read.option("mode", "DROPMALFORMED").json(paths)
    runs = rows.where("t = 'run'").withColumn("ts", F.col("ts").cast("timestamp"))
    return runs, rows.where("t = 'm'")


def trustworthy(runs: DataFrame) -> DataFrame:
    """Clean trees on quiet machines."""
    return runs.where("not dirty and loadavg_at_start < 2.0")


def headline(m: DataFrame, keys: list[str]) -> DataFrame:
    return m.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.median("value").alias("median"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (F.max("value") - F.min("value")).alias("spread"),
        F.when(F.count("*") < 3, PROVISIONAL).alias("caveat"),
    )


def quantiles(m: DataFrame, keys: list[str]) -> DataFrame:
    ratio = F.try_divide(F.max("value"), F.nullif(F.median("value"), F.lit(0.0)))
    return m.groupBy(*keys).agg(F.sum("value").alias("total"), F.median("value").alias("p50"), F.percentile("value", F.lit(0.99)).alias("p99"), F.max("value").alias("max"), ratio.alias("max_over_p50"))


def pivot_medians(m: DataFrame, keys: list[str], phase: Column, phases: tuple[str, str]) -> DataFrame:
    """Median of each of two phases side by side, where they differ (nulls count as values)."""
    a, b = (F.median(F.when(phase == p, F.col("value"))) for p in phases)
    return m.groupBy(*keys).agg(a.alias(phases[0]), b.alias(phases[1])).where(~F.col(phases[0]).eqNullSafe(F.col(phases[1])))


def nearest_rank(values: Column, share: float) -> Column:
    """The nearest-rank quantile, sorted[min(n-1, int(n*share))], of a collected array of values."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, F.least(F.size(ordered), F.floor(F.size(ordered) * share).cast("int") + 1))


def regressions(series: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """series (keys, ts, med, spread, n) with the previous run beside it, and whether the move clears the noise."""
    w = Window.partitionBy(*keys).orderBy(ts)
    out = series.withColumn("prev_med", F.lag("med").over(w)).withColumn("prev_spread", F.lag("spread").over(w)).withColumn("prev_n", F.lag("n").over(w))
    return out.withColumn("flag", F.abs(F.col("med") - F.col("prev_med")) > F.greatest("spread", "prev_spread", F.lit(1.0)))


def baseline_check(fresh: DataFrame, baseline: DataFrame, on: list[str], ratio: float = 1.1) -> DataFrame:
    """fresh (value, spread) against baseline (base, base_spread), with a verdict."""
    worse = (F.col("value") > F.col("base") * ratio) & (F.col("value") - F.col("base") > F.greatest("spread", "base_spread"))
    better = (F.col("value") * ratio < F.col("base")) & (F.col("base") - F.col("value") > F.greatest("spread", "base_spread"))
    return fresh.join(baseline, on).withColumn("verdict", F.when(worse, REGRESSED).when(better, IMPROVED).otherwise(UNCHANGED))


def classify(base: Column, head: Column) -> Column:
    """The shape of two answer sets (arrays, null for no answer)."""
    none = lambda x: x.isNull() | (F.size(x) == 0)
    return (
        F.when(none(base) & none(head), "both_empty")
        .when(none(base), "only_head")
        .when(none(head), "only_base")
        .when((F.size(F.array_except(base, head)) == 0) & (F.size(F.array_except(head, base)) == 0), "equal")
        .when(F.size(F.array_except(base, head)) == 0, "superset")
        .when(F.size(F.array_except(head, base)) == 0, "subset")
        .when(F.size(F.array_intersect(base, head)) > 0, "overlap")
        .otherwise("disagree")
    )


def compare_answers(base: DataFrame, head: DataFrame, on: list[str]) -> DataFrame:
    """Full outer comparison of answers per position and verb."""
    return base.withColumnRenamed("answer", "base").join(head.withColumnRenamed("answer", "head"), on, "full_outer").withColumn("shape", classify(F.col("base"), F.col("head")))


def exclusive_time(spans: DataFrame) -> DataFrame:
    """spans (id, parent, ns) with each span's own time: what its children don't account for."""
    inner = spans.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.sum("ns").alias("inner_ns"))
    return spans.join(inner, "id", "left").withColumn("own_ns", F.col("ns") - F.coalesce("inner_ns", F.lit(0)))
