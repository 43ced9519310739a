"""What is kept beside the facts and holds until they move: certificates of closed classes, and an overlay of derived values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators import closedness as C
from factloom.operators.graph import cut
from factloom.plans.q_graph import _id, hierarchy
from factloom.plans.registry import register
from factloom.sources.facts import table
from factloom.streaming import overlay as O


def _providers(spark: SparkSession, d: str, later: bool) -> DataFrame:
    """Each company's file provides its class, customers provide their nation; later some moved, left or arrived, by the nation's number."""
    c, n, k = table(spark, d, "customer"), F.col("c_nationkey"), F.col("c_custkey")
    print_ = k % 97 + (F.when(n % 5 == 1, k % 2).otherwise(0) if later else 0)
    own = c.where(~((n % 5 == 2) & (k % 10 == 0))) if later else c
    rows = own.select(_id("N", "c_nationkey").alias("name"), _id("c", "c_custkey").alias("path"), print_.cast("long").alias("fingerprint"))
    if later:
        new = c.where((n % 5 == 4) & (k % 10 == 1))
        rows = rows.unionByName(new.select(_id("N", "c_nationkey").alias("name"), _id("new", "c_custkey").alias("path"), F.lit(0).cast("long").alias("fingerprint")))
    vouched = F.when(F.col("s_acctbal") >= 0, F.col("s_nationkey").cast("long"))
    return rows.unionByName(table(spark, d, "supplier").select(_id("S", "s_suppkey").alias("name"), _id("s", "s_suppkey").alias("path"), vouched.alias("fingerprint")))


@register("closedness", """WITH n AS (SELECT c_nationkey AS n, bool_or(c_nationkey % 5 = 1 AND c_custkey % 2 = 1 OR c_nationkey % 5 = 2 AND c_custkey % 10 = 0 OR c_nationkey % 5 = 4 AND c_custkey % 10 = 1) AS moved FROM customer GROUP BY ALL)
SELECT 'S' || s_suppkey AS origin, CASE WHEN s_nationkey % 10 = 5 THEN 'bridged' WHEN s_acctbal < 0 THEN 'unvouched' WHEN coalesce(moved, false) THEN 'minted' ELSE 'kept' END AS state,
 CASE WHEN s_nationkey % 10 <> 5 AND s_acctbal >= 0 THEN 3 ELSE 0 END AS names FROM supplier LEFT JOIN n ON s_nationkey = n""")
def closedness(spark: SparkSession, d: str) -> DataFrame:
    """Certificates of all suppliers' classes after customers' files moved: which still hold, which were made anew, which can't be."""
    classes = table(spark, d, "supplier").select(_id("S", "s_suppkey").alias("origin"))
    inherits = hierarchy(spark, d).where("src not like 'C%'")
    bridged = table(spark, d, "nation").where("n_nationkey % 10 = 5").select(_id("N", "n_nationkey").alias("name"))
    before, _ = C.mint(classes, inherits, _providers(spark, d, False), bridged)
    touched = table(spark, d, "customer").where("c_nationkey % 5 > 0").select(_id("N", "c_nationkey").alias("name"))  # nations of rest 3 are touched, and are what they were
    state, certificates = C.consult(classes, before, touched, inherits, _providers(spark, d, True), bridged)
    return state.join(certificates.groupBy("origin").agg(F.count("*").alias("names")), "origin", "left").fillna(0, ["names"])


@register("enrichment_overlay", """WITH r AS (SELECT r_regionkey AS r, CASE WHEN r_regionkey % 2 = 0 THEN 'New' ELSE 'Old' END || r_regionkey AS value FROM region),
n AS (SELECT n_nationkey AS n, n_regionkey AS r, CASE WHEN n_nationkey % 3 = 0 THEN 'Own' || n_nationkey ELSE value END AS value FROM nation JOIN r ON n_regionkey = r),
k AS (SELECT 'C' || c_custkey AS key, c_nationkey AS n FROM customer UNION ALL SELECT 'S' || s_suppkey, s_nationkey FROM supplier)
SELECT 'N' || n AS key, value, CASE WHEN r % 2 = 0 THEN 1 ELSE 0 END AS derived_in FROM n
UNION ALL SELECT key, value, CASE WHEN r % 2 = 0 AND n % 3 <> 0 THEN 2 ELSE 0 END FROM k JOIN n USING (n)""")
def enrichment_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Types that companies take from their nations and these from their regions, after regions changed: only what read a moved value is derived again."""
    requires = hierarchy(spark, d).select(F.col("src").alias("reader"), F.col("dst").alias("provider"))
    regions = table(spark, d, "region").select(_id("R", "r_regionkey").alias("key"), F.concat(F.lit("Old"), F.col("r_regionkey").cast("string")).alias("value"))

    def derive(asked: DataFrame, values: DataFrame) -> DataFrame:
        from_ = requires.join(asked.withColumnRenamed("key", "reader"), "reader", "left_semi").join(values.withColumnRenamed("key", "provider"), "provider")
        own = F.col("reader").startswith("N") & (F.substring("reader", 2, 9).try_cast("int") % 3 == 0)
        return from_.select(F.col("reader").alias("key"), F.when(own, F.concat(F.lit("Own"), F.substring("reader", 2, 9))).otherwise(F.col("value")).alias("value"))

    empty = regions.where("false")
    first = O.refresh(requires, regions, empty.select("key", F.lit(0).cast("decimal(38,0)").alias("seal")), regions, derive)
    moved = F.substring("key", 2, 9).cast("int") % 2 == 0
    now = regions.select("key", F.when(moved, F.replace("value", F.lit("Old"), F.lit("New"))).otherwise(F.col("value")).alias("value"))
    view = O.refresh(requires, cut(O.replaced(first.values, now)), first.seals, regions.where(moved), derive)
    return view.values.where("key not like 'R%'").join(view.derived, "key", "left").select("key", "value", F.coalesce("round", F.lit(0)).alias("derived_in"))
