"""Queries of template matching, loader configuration and hooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators import specialize as S
from factloom.plans.registry import register
from factloom.sources.facts import table

PATTERNS = "(0, '*', '*'), (1, 'SMALL', '*'), (2, '*', 'Brand#2'), (3, 'SMALL', 'Brand#2'), (4, 'ECONOMY', 'Brand#7')"


@register("partial_specs", f"WITH p(pid, t, b) AS (VALUES {PATTERNS}), m AS (SELECT p_partkey, pid, (t <> '*')::INT + (b <> '*')::INT AS fixed FROM part JOIN p ON (t = '*' OR t = p_type) AND (b = '*' OR b = p_brand)) SELECT p_partkey, pid, fixed FROM m a WHERE fixed = (SELECT max(fixed) FROM m c WHERE c.p_partkey = a.p_partkey)")
def partial_specs(spark: SparkSession, d: str) -> DataFrame:
    """The most special patterns an instance meets."""
    patterns = spark.sql(f"SELECT * FROM VALUES {PATTERNS} AS t(pid, t, b)")
    parts = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("t"), F.col("p_brand").alias("b"))
    return S.matching_specs(parts, patterns, ["t", "b"], "p_partkey", "pid").select("p_partkey", "pid", "fixed")


@register("loader_parameters", "WITH g AS (SELECT c_custkey AS class, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) END AS given FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY c_custkey) SELECT c_custkey AS class, 'status' AS name, coalesce(CASE WHEN c_acctbal > 9000 THEN 'own' END, given) AS type FROM customer LEFT JOIN g ON class = c_custkey")
def loader_parameters(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    loads = o.select(F.col("o_custkey").alias("class"), F.col("o_orderkey").alias("loader"))
    configs = o.select(F.col("o_orderkey").alias("loader"), F.lit("status").alias("name"), F.col("o_orderstatus").alias("type"))
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("class"), F.lit("status").alias("name"), F.when(F.col("c_acctbal") > 9000, "own").alias("type"))
    return S.loader_parameters(loads, configs, own)


@register("hooked_answer", "SELECT s_name AS label FROM supplier WHERE s_nationkey = 3 UNION SELECT n_name FROM nation WHERE n_nationkey = 3")
def hooked_answer(spark: SparkSession, d: str) -> DataFrame:
    """Own rows with what a hook adds."""
    own = table(spark, d, "supplier").where("s_nationkey = 3").select(F.col("s_name").alias("label"))
    extra = lambda q: S.HookAnswer(table(spark, d, "nation").where("n_nationkey = 3").select(F.col("n_name").alias("label"))) if q == "completion" else None
    return S.answer("completion", own, [lambda q: None, extra])
