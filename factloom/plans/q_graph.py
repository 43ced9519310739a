"""Graph queries: a class hierarchy over regions, nations and companies, and a denser graph over parts and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.model import EDGE_KINDS
from factloom.operators import graph as G
from factloom.plans.registry import register
from factloom.sources.facts import table

H_SQL = """e AS (SELECT 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst, 0 AS ord FROM nation
 UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 0 FROM customer UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 0 FROM supplier)"""
P_SQL = "e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst, 0 AS ord FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey, p_partkey // 3, 1 FROM part WHERE p_partkey > 0)"


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    kind = F.lit(EDGE_KINDS["inherits"]).alias("kind")
    of = lambda t, a, x, b, y: table(spark, d, t).select(_id(a, x).alias("src"), _id(b, y).alias("dst"), kind, F.lit(0).alias("ord"))
    return of("nation", "N", "n_nationkey", "R", "n_regionkey").unionByName(of("customer", "C", "c_custkey", "N", "c_nationkey")).unionByName(of("supplier", "S", "s_suppkey", "N", "s_nationkey"))


def parts_graph(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("src"))
    half = p.select("src", F.floor(F.col("src") / 2).alias("dst"), F.lit(1).alias("kind"), F.lit(0).alias("ord"))
    return half.unionByName(p.select("src", F.floor(F.col("src") / 3).alias("dst"), F.lit(1).alias("kind"), F.lit(1).alias("ord")))


@register("edges_masked", f"WITH {H_SQL} SELECT src, dst, 1 AS kind FROM e UNION ALL SELECT dst, src, 4 FROM e")
def edges_masked(spark: SparkSession, d: str) -> DataFrame:
    """Inherits edges and their inverse, by mask."""
    return G.masked(G.inverted(hierarchy(spark, d)), EDGE_KINDS["inherits"] | EDGE_KINDS["inherits_inv"]).select("src", "dst", "kind")


@register("ancestors_mro", f"WITH {H_SQL} SELECT a.src AS origin, a.dst AS node, 1 AS rank FROM e a WHERE a.src LIKE 'S%' UNION ALL SELECT a.src, b.dst, 2 FROM e a JOIN e b ON a.dst = b.src WHERE a.src LIKE 'S%'")
def ancestors_mro(spark: SparkSession, d: str) -> DataFrame:
    """Ancestors in depth-first order."""
    seeds = table(spark, d, "supplier").select(_id("S", "s_suppkey").alias("origin"))
    return G.depth_first(hierarchy(spark, d), seeds)


@register("closure_parts", f"WITH RECURSIVE {P_SQL}, c AS (SELECT p_partkey AS origin, p_partkey AS node, 0 AS depth FROM part UNION SELECT origin, dst, depth + 1 FROM c JOIN e ON node = src WHERE depth < 20) SELECT origin, node, min(depth) AS depth FROM c WHERE node <> origin GROUP BY origin, node")
def closure_parts(spark: SparkSession, d: str) -> DataFrame:
    """Everything reachable from every part, with fewest steps: diamonds at every level."""
    seeds = table(spark, d, "part").select(F.col("p_partkey").alias("origin"))
    return G.closure(parts_graph(spark, d), seeds).select("origin", "node", "depth")


@register("closure_capped", f"WITH RECURSIVE {P_SQL}, c AS (SELECT p_partkey AS origin, p_partkey AS node, 0 AS depth FROM part UNION SELECT origin, dst, depth + 1 FROM c JOIN e ON node = src WHERE depth < 2) SELECT origin, node, min(depth) AS depth, min(depth) = 2 AND node > 0 AS truncated FROM c WHERE node <> origin GROUP BY origin, node")
def closure_capped(spark: SparkSession, d: str) -> DataFrame:
    """At most two steps, with the flag of walks that had further to go."""
    seeds = table(spark, d, "part").select(F.col("p_partkey").alias("origin"))
    return G.closure(parts_graph(spark, d), seeds, max_depth=2)


@register("descendants", f"WITH {H_SQL} SELECT a.dst AS origin, a.src AS node, 1 AS depth FROM e a WHERE a.dst LIKE 'R%' UNION ALL SELECT a.dst, b.src, 2 FROM e a JOIN e b ON b.dst = a.src WHERE a.dst LIKE 'R%'")
def descendants(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "region").select(_id("R", "r_regionkey").alias("origin"))
    back = hierarchy(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.closure(back, seeds).select("origin", "node", "depth")


@register("type_hierarchy", f"WITH {H_SQL} SELECT src AS name, 'supertype' AS direction, dst AS type FROM e UNION ALL SELECT dst, 'subtype', src FROM e")
def type_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """One level up and one level down, as rows: a class may have any number of subtypes."""
    return G.neighbours(hierarchy(spark, d))


M_SQL = "m AS (SELECT 'C' || c_custkey AS node, 'pay' AS method FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 'S' || s_suppkey, 'pay' FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT 'N' || n_nationkey, 'pay' FROM nation WHERE n_nationkey % 2 = 0)"


def _methods(spark: SparkSession, d: str) -> DataFrame:
    pay = F.lit("pay").alias("method")
    c = table(spark, d, "customer").where("c_acctbal > 9000").select(_id("C", "c_custkey").alias("node"), pay)
    s = table(spark, d, "supplier").where("s_acctbal > 5000").select(_id("S", "s_suppkey").alias("node"), pay)
    return c.unionByName(s).unionByName(table(spark, d, "nation").where("n_nationkey % 2 = 0").select(_id("N", "n_nationkey").alias("node"), pay))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(_id("N", "n_nationkey").alias("origin"), F.lit("pay").alias("method"))


@register("override_family", f"WITH {H_SQL}, {M_SQL} SELECT 'N' || n_nationkey AS origin, m.node AS member FROM nation JOIN m ON m.node = 'N' || n_nationkey OR m.node IN (SELECT src FROM e WHERE dst = 'N' || n_nationkey)")
def override_family(spark: SparkSession, d: str) -> DataFrame:
    return G.override_family(hierarchy(spark, d), _methods(spark, d), _targets(spark, d))


@register("implementations", f"WITH {H_SQL}, {M_SQL} SELECT e.dst AS origin, m.node AS member FROM e JOIN m ON m.node = e.src WHERE e.dst LIKE 'N%'")
def implementations(spark: SparkSession, d: str) -> DataFrame:
    """Definitions below a contract, without the contract's own line."""
    return G.implementations(hierarchy(spark, d), _methods(spark, d), _targets(spark, d))


@register("dispatch_participants", f"WITH {H_SQL} SELECT dst AS origin, src AS node FROM e WHERE dst LIKE 'N%' UNION SELECT 'N' || n_nationkey, 'N' || n_nationkey FROM nation UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation")
def dispatch_participants(spark: SparkSession, d: str) -> DataFrame:
    return G.dispatch_participants(hierarchy(spark, d), _targets(spark, d).select("origin"))


@register("method_resolution", f"WITH {H_SQL}, {M_SQL} SELECT 'S' || s_suppkey AS origin, 'pay' AS method, 'N' || s_nationkey AS owner FROM supplier WHERE s_nationkey % 2 = 0")
def method_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The first ancestor that declares a method."""
    seeds = table(spark, d, "supplier").select(_id("S", "s_suppkey").alias("origin"))
    return G.methods_in_order(G.depth_first(hierarchy(spark, d), seeds), _methods(spark, d))


@register("isa_filter", f"WITH {H_SQL} SELECT a.src AS child FROM e a JOIN e b ON a.dst = b.src WHERE b.dst = 'R1' AND a.src LIKE 'S%'")
def isa_filter(spark: SparkSession, d: str) -> DataFrame:
    """Classes that descend from one class."""
    seeds = spark.sql("SELECT 'R1' AS origin")
    back = hierarchy(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.closure(back, seeds).where("node like 'S%'").select(F.col("node").alias("child"))


@register("unresolved_ancestor", f"WITH {H_SQL} SELECT 'S' || s_suppkey AS origin, s_nationkey % 5 <> 0 AS closed, false AS truncated FROM supplier")
def unresolved_ancestor(spark: SparkSession, d: str) -> DataFrame:
    """Whether all ancestors are known where every fifth nation is missing."""
    nations = table(spark, d, "nation")
    known = nations.where("n_nationkey % 5 <> 0").select(_id("N", "n_nationkey").alias("node")).union(table(spark, d, "region").select(_id("R", "r_regionkey")))
    return G.unresolved(hierarchy(spark, d), table(spark, d, "supplier").select(_id("S", "s_suppkey").alias("origin")), known)


@register("alias_chain", "WITH RECURSIVE c AS (SELECT p_partkey AS src, p_partkey // 2 AS \"to\", 1 AS hops FROM part WHERE p_partkey >= 5 UNION ALL SELECT src, \"to\" // 2, hops + 1 FROM c WHERE \"to\" >= 5) SELECT src, \"to\" AS terminal, hops FROM c WHERE \"to\" < 5")
def alias_chain(spark: SparkSession, d: str) -> DataFrame:
    """Terminal of each alias by pointer jumping."""
    return G.resolve_chains(table(spark, d, "part").where("p_partkey >= 5").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst")), 5)


DIRTY_SQL = "p AS (SELECT o_orderkey AS file, o_custkey AS name FROM orders WHERE o_orderkey % 4 = 0), c AS (SELECT o_orderkey AS file, o_custkey AS name FROM orders WHERE o_orderkey % 4 IN (0, 1) AND o_orderkey % 3 = 0)"


@register("dirty_closure", f"WITH RECURSIVE {DIRTY_SQL}, s AS (SELECT DISTINCT p.file AS src, c.file AS dst FROM p JOIN c USING (name) WHERE p.file <> c.file), x AS (SELECT o_orderkey AS file FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'), r AS (SELECT file FROM x UNION SELECT dst FROM r JOIN s ON r.file = s.src) SELECT file FROM r ANTI JOIN x USING (file)")
def dirty_closure(spark: SparkSession, d: str) -> DataFrame:
    """Consumers of what changed files provide, however far."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("name"), (F.col("o_orderstatus") == "P").alias("open"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return G.dirty_closure(o.where("file % 4 = 0").select("file", "name"), o.where("file % 4 in (0, 1) and file % 3 = 0").select("file", "name"), o.where("open and urgent").select("file"))


@register("reexport_walk", f"WITH RECURSIVE {P_SQL}, c AS (SELECT p_partkey AS origin, p_partkey AS node, 0 AS depth FROM part UNION SELECT origin, dst, depth + 1 FROM c JOIN e ON node = src WHERE depth < 20), f AS (SELECT origin, node, min(depth) AS depth FROM c WHERE node <> origin AND node % 7 = 3 GROUP BY ALL) SELECT origin, arg_min(node, (depth, node)) AS definer, min(depth) AS depth FROM f GROUP BY origin")
def reexport_walk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest definer over re-export edges."""
    seeds = table(spark, d, "part").select(F.col("p_partkey").alias("origin"))
    found = G.closure(parts_graph(spark, d), seeds).where("node % 7 = 3")
    return found.groupBy("origin").agg(F.min_by("node", F.struct("depth", "node")).alias("definer"), F.min("depth").alias("depth"))


@register("include_two_hop", f"WITH {P_SQL}, s AS (SELECT DISTINCT src, dst FROM e) SELECT DISTINCT a.src AS file_id FROM s a WHERE a.dst = 100 OR a.dst IN (SELECT src FROM s WHERE dst = 100)")
def include_two_hop(spark: SparkSession, d: str) -> DataFrame:
    """Files that see a definition: they include it, or include one that does."""
    s = parts_graph(spark, d).select("src", "dst").distinct()
    one = s.where("dst = 100").select("src")
    two = s.join(one.select(F.col("src").alias("dst")), "dst", "left_semi").select("src")
    return one.union(two).distinct().select(F.col("src").alias("file_id"))


@register("call_incoming", "SELECT l_partkey AS callee, l_suppkey AS caller, list_sort(list(l_orderkey)) AS sites FROM lineitem GROUP BY l_partkey, l_suppkey")
def call_incoming(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "lineitem")
    return calls.groupBy(F.col("l_partkey").alias("callee"), F.col("l_suppkey").alias("caller")).agg(F.sort_array(F.collect_list("l_orderkey")).alias("sites"))


@register("call_outgoing", "SELECT l_suppkey AS caller, l_partkey AS callee, count(*) AS n_sites FROM lineitem GROUP BY l_suppkey, l_partkey")
def call_outgoing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee")).agg(F.count("*").alias("n_sites"))


@register("specialization_family", "SELECT p_type AS primary_name, list_sort(list(DISTINCT p_brand)) AS specs FROM part GROUP BY p_type")
def specialization_family(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_type").alias("primary_name")).agg(F.sort_array(F.collect_set("p_brand")).alias("specs"))


@register("bridge_join", "SELECT c_custkey AS class, s_suppkey AS entity FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_mktsegment = 'BUILDING' AND s_acctbal > 8000")
def bridge_join(spark: SparkSession, d: str) -> DataFrame:
    """Entities of the namespaces bridged to a class."""
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("class"), F.col("c_nationkey").alias("ns"))
    return c.join(table(spark, d, "supplier").where("s_acctbal > 8000").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("ns")), "ns").select("class", "entity")


@register("union_overlay", "SELECT a.l_orderkey AS scope, a.l_linenumber AS member, list_sort(list(b.l_linenumber)) AS others FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber GROUP BY ALL")
def union_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Members that share a scope, each with the others: from one list per scope, not from a self join."""
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("all"))
    each = per.select(F.col("l_orderkey").alias("scope"), "all", F.explode("all").alias("member")).withColumn("others", F.filter("all", lambda x: x != F.col("member")))
    each = each.groupBy("scope", "member").agg(F.flatten(F.collect_list("others")).alias("others"))
    return each.where(F.size("others") > 0).select("scope", "member", F.sort_array("others").alias("others"))
