"""Queries of the extension surface and of the extract stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions import extension as X
from factloom.plans.registry import register
from factloom.sources.facts import table

LICENSES = X.Plugin(
    "licenses",
    (X.Pattern("license_line", r"^(?:Licensed|Released) under (?:the )?([A-Z]+)", "Symbol", {"Licensed under the MIT License.": 1, "no": 0}), X.Pattern("secret", r"token = \"([0-9a-f]{8})", "Diagnostic", {'token = "0123abcd"': 1})),
)
ROWS_SQL = "e AS (SELECT doc_id AS file_id, 'license_line' AS pattern, 'Symbol' AS kind, unnest(regexp_extract_all(text, '(?m)^(?:Licensed|Released) under (?:the )?([A-Z]+)', 1)) AS name FROM documents UNION ALL SELECT doc_id, 'secret', 'Diagnostic', unnest(regexp_extract_all(text, 'token = \"([0-9a-f]{8})', 1)) FROM documents)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "text")


@register("udtf_emit", f"WITH {ROWS_SQL} SELECT * FROM e")
def udtf_emit(spark: SparkSession, d: str) -> DataFrame:
    """One match to any number of emitted rows."""
    return X.emit(_files(spark, d), LICENSES)


@register("trigger_filter", f"WITH {ROWS_SQL} SELECT e.file_id, name FROM e JOIN documents ON doc_id = e.file_id WHERE contains(text, 'Licensed')")
def trigger_filter(spark: SparkSession, d: str) -> DataFrame:
    return X.emit(_files(spark, d), X.Plugin("l", LICENSES.patterns, uses="Licensed")).select("file_id", "name")


@register("gated_emissions", "SELECT s_suppkey AS class, 'R' || n_regionkey AS gate FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = s_suppkey % 5")
def gated_emissions(spark: SparkSession, d: str) -> DataFrame:
    """Deferred rows whose class descends from their gate."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    isa = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("origin"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("node"))
    emitted = s.select(F.col("s_suppkey").alias("class"), F.concat(F.lit("R"), (F.col("s_suppkey") % 5).cast("string")).alias("gate"))
    return X.gated(emitted, isa)


@register("manifest_override", "SELECT p_partkey, p_brand AS class, p_type AS method, CASE WHEN p_brand = 'Brand#2' AND p_type = 'SMALL' THEN 'Forced' ELSE 'Plain' END AS type FROM part")
def manifest_override(spark: SparkSession, d: str) -> DataFrame:
    types = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("class"), F.col("p_type").alias("method"), F.lit("Plain").alias("type"))
    return X.with_overrides(types, [X.Plugin("o", (), overrides={("Brand#2", "SMALL"): "Forced"})]).select("p_partkey", "class", "method", "type")


@register("udf_type_inner", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Int' ELSE p_type END AS inner_type FROM part")
def udf_type_inner(spark: SparkSession, d: str) -> DataFrame:
    """A vectorised function of the extension surface."""
    spelt = F.when(F.col("p_size") % 2 == 0, "Maybe[ArrayRef[Int]]").otherwise(F.concat(F.lit("Maybe["), "p_type", F.lit("]")))
    return table(spark, d, "part").select("p_partkey", X.type_inner()(spelt).alias("inner_type"))


@register("udaf_join", "SELECT user_id AS key, coalesce(max(CASE WHEN event_type = 'error' THEN 'error' END), min(event_type)) AS value FROM events GROUP BY user_id")
def udaf_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_type")
    return X.reducers(e, "key", [F.max(F.when(F.col("event_type") == "error", "error")), F.min("event_type")])


@register("lateral_tokens", "SELECT p_partkey, count(*) AS n FROM (SELECT p_partkey, unnest(regexp_extract_all(p_name, '[A-Za-z_][0-9A-Za-z_]*')) AS w FROM part) GROUP BY p_partkey")
def lateral_tokens(spark: SparkSession, d: str) -> DataFrame:
    """A Python table function under LATERAL."""
    X.register(spark)
    table(spark, d, "part").createOrReplaceTempView("factloom_part")
    return spark.sql("SELECT p_partkey, count(*) AS n FROM factloom_part, LATERAL tokens(p_name) GROUP BY p_partkey")


@register("argument_slot", "SELECT p_partkey, p_size % 4 AS slot FROM part")
def argument_slot(spark: SparkSession, d: str) -> DataFrame:
    """Separators before the cursor, outside of nested brackets."""
    text = F.concat(F.lit("f(1, 2), [3, {4, 5}]"), F.repeat(F.lit(", x(y, z)"), (F.col("p_size") % 4).cast("int")))
    return table(spark, d, "part").select("p_partkey", (X.argument_slot(text) - 1).cast("int").alias("slot"))


@register("emission_diff", f"WITH {ROWS_SQL} SELECT file_id, name FROM e WHERE pattern = 'secret'")
def emission_diff(spark: SparkSession, d: str) -> DataFrame:
    """What a plugin adds to what was there."""
    base = X.emit(_files(spark, d), X.Plugin("base", LICENSES.patterns[:1]))
    return X.emit(_files(spark, d), LICENSES).exceptAll(base).select("file_id", "name")
