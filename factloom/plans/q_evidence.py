"""Evidence queries: events as witnesses of their user's type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators import evidence as E, graph as G
from factloom.plans.registry import register
from factloom.sources.facts import table

T_SQL = "CASE CAST(floor(value) AS INT) % 7 WHEN 0 THEN 'Numeric' WHEN 1 THEN 'Bool' WHEN 2 THEN 'HashRef' WHEN 3 THEN 'Class:Foo' WHEN 4 THEN NULL WHEN 5 THEN 'ArrayRef' ELSE 'Hash{k}' END"
W_SQL = f"w AS (SELECT user_id * 1000 + (event_id % 97) AS att, event_type, CASE event_type WHEN 'error' THEN 100 WHEN 'purchase' THEN 20 ELSE 10 END AS priority, {T_SQL} AS type, event_id AS seq FROM events)"
AGREE = "CASE WHEN min(type) = max(type) THEN min(type) WHEN bool_and(starts_with(type, 'Hash')) THEN 'HashRef' WHEN bool_and(starts_with(type, 'Array') OR starts_with(type, 'Sequence')) THEN 'ArrayRef' WHEN bool_and(type IN ('Bool', 'Numeric')) THEN 'Numeric' WHEN bool_and(starts_with(type, 'Class:') OR starts_with(type, 'Hash')) THEN arg_max(type, seq) FILTER (starts_with(type, 'Class:')) END"
LIFT = f"CASE WHEN bool_or(type IS NULL) AND ({AGREE}) IS NOT NULL THEN 'Optional<' || ({AGREE}) || '>' ELSE ({AGREE}) END"


def witnesses(spark: SparkSession, d: str) -> DataFrame:
    n = F.floor("value").cast("int") % 7
    kind = F.when(n == 0, "Numeric").when(n == 1, "Bool").when(n == 2, "HashRef").when(n == 3, "Class:Foo").when(n == 4, F.lit(None)).when(n == 5, "ArrayRef").otherwise("Hash{k}")
    priority = F.when(F.col("event_type") == "error", E.OVERRIDE_PRIORITY).when(F.col("event_type") == "purchase", E.ANNOTATION_PRIORITY).otherwise(E.DEFAULT_PRIORITY)
    return table(spark, d, "events").select((F.col("user_id") * 1000 + F.col("event_id") % 97).alias("att"), "event_type", priority.alias("priority"), kind.alias("type"), F.col("event_id").alias("seq"))


def _fold(spark: SparkSession, d: str, fold) -> DataFrame:
    return witnesses(spark, d).groupBy("att").agg(fold.alias("type")).where("type is not null")




@register("reduce_latest", f"WITH {W_SQL} SELECT att, arg_max(type, seq) FILTER (type IS NOT NULL) AS type FROM w GROUP BY att HAVING count(type) > 0")
def reduce_latest(spark: SparkSession, d: str) -> DataFrame:
    return _fold(spark, d, E.latest(F.col("type"), F.col("seq")))


@register("reduce_priority", f"WITH {W_SQL} SELECT att, arg_max(type, (priority, seq)) AS type FROM w WHERE priority > 10 AND type IS NOT NULL GROUP BY att")
def reduce_priority(spark: SparkSession, d: str) -> DataFrame:
    return _fold(spark, d, E.override(F.col("type"), F.col("priority"), F.col("seq")))


@register("reduce_agreement", f"WITH {W_SQL}, r AS (SELECT att, {AGREE} AS type FROM w GROUP BY att) SELECT * FROM r WHERE type IS NOT NULL")
def reduce_agreement(spark: SparkSession, d: str) -> DataFrame:
    return _fold(spark, d, E.agreement(F.col("type"), F.col("seq")))


@register("reduce_optional", f"WITH {W_SQL}, r AS (SELECT att, {LIFT} AS type FROM w GROUP BY att) SELECT * FROM r WHERE type IS NOT NULL")
def reduce_optional(spark: SparkSession, d: str) -> DataFrame:
    return _fold(spark, d, E.return_arms(F.col("type"), F.col("seq")))


@register("reduce_slot", f"WITH {W_SQL}, v AS (SELECT att, seq, CASE WHEN type = 'Class:Foo' AND seq % 2 = 0 THEN 'Class:Bar' ELSE type END AS type FROM w), r AS (SELECT att, CASE WHEN count(DISTINCT type) FILTER (starts_with(type, 'Class:')) <= 1 THEN {AGREE} END AS type FROM v GROUP BY att) SELECT * FROM r WHERE type IS NOT NULL")
def reduce_slot(spark: SparkSession, d: str) -> DataFrame:
    w = witnesses(spark, d).withColumn("type", F.when((F.col("type") == "Class:Foo") & (F.col("seq") % 2 == 0), "Class:Bar").otherwise(F.col("type")))
    return w.groupBy("att").agg(E.slot(F.col("type"), F.col("seq")).alias("type")).where("type is not null")


@register(
    "reduce_branch",
    f"""WITH {W_SQL}, r AS (SELECT att, arg_min(type, seq) FILTER (type IS NOT NULL AND event_type = 'view') AS floor, CASE WHEN min(type) = max(type) THEN min(type) END AS agreed, count(*) AS n, bool_or(type IS NULL) AS undef FROM w GROUP BY att),
    s AS (SELECT att, CASE WHEN floor IS NOT NULL THEN coalesce(agreed, floor) WHEN n >= 2 THEN CASE WHEN undef THEN 'Optional<' || agreed || '>' ELSE agreed END END AS type FROM r) SELECT * FROM s WHERE type IS NOT NULL""",
)
def reduce_branch(spark: SparkSession, d: str) -> DataFrame:
    return _fold(spark, d, E.branch_arms(F.col("type"), F.col("seq"), F.col("event_type") == "view"))


@register(
    "reduce_majority",
    "WITH v AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT o_custkey, sum(n) AS total FROM v GROUP BY o_custkey) SELECT o_custkey, o_orderstatus AS winner, n, total::BIGINT AS total FROM v JOIN t USING (o_custkey) WHERE total >= 2 AND 2 * n > total",
)
def reduce_majority(spark: SparkSession, d: str) -> DataFrame:
    return E.majority(table(spark, d, "orders").select("o_custkey", "o_orderstatus"), ["o_custkey"], "o_orderstatus")


@register("reducer_ladder", f"WITH {W_SQL}, r AS (SELECT att, coalesce(arg_max(type, (priority, seq)) FILTER (priority > 10 AND type IS NOT NULL), {LIFT}, arg_max(type, seq) FILTER (type IS NOT NULL)) AS type FROM w GROUP BY att) SELECT * FROM r WHERE type IS NOT NULL")
def reducer_ladder(spark: SparkSession, d: str) -> DataFrame:
    """All reducers over one pass, the first that answers wins."""
    return _fold(spark, d, E.ladder(F.col("type"), F.col("priority"), F.col("seq")))


@register("edge_chase", "WITH RECURSIVE c AS (SELECT p_partkey AS src, p_partkey AS pos FROM part UNION ALL SELECT src, pos // 2 FROM c WHERE pos % 4 <> 0) SELECT c.src, p_type AS type FROM c JOIN part ON p_partkey = pos WHERE pos % 4 = 0")
def edge_chase(spark: SparkSession, d: str) -> DataFrame:
    """Evidence that points at another key takes that key's type, however far the chain goes."""
    p = table(spark, d, "part")
    ends = G.resolve_chains(p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst")), 5)
    types = p.select(F.col("p_partkey").alias("terminal"), F.col("p_type").alias("type"))
    return ends.select("src", "terminal").unionByName(p.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("src"), F.col("p_partkey").alias("terminal"))).join(types, "terminal").select("src", "type")


@register("method_return_type", f"WITH {W_SQL}, r AS (SELECT att % 1000 AS method, att // 1000 AS class, arg_max(type, seq) FILTER (type IS NOT NULL) AS type FROM w GROUP BY att HAVING count(type) > 0) SELECT c_custkey, method, arg_min(type, depth) AS type FROM (SELECT c_custkey, 0 AS depth, c_custkey % 150 AS class FROM customer UNION ALL SELECT c_custkey, 1, c_nationkey FROM customer) a JOIN r USING (class) GROUP BY c_custkey, method")
def method_return_type(spark: SparkSession, d: str) -> DataFrame:
    """The first class in resolution order that has a type for the method."""
    r = witnesses(spark, d).groupBy("att").agg(E.latest(F.col("type"), F.col("seq")).alias("type")).where("type is not null")
    r = r.select((F.col("att") % 1000).alias("method"), F.floor(F.col("att") / 1000).alias("class"), "type")
    c = table(spark, d, "customer")
    order = c.select("c_custkey", F.lit(0).alias("depth"), (F.col("c_custkey") % 150).alias("class")).unionByName(c.select("c_custkey", F.lit(1).alias("depth"), F.col("c_nationkey").cast("long").alias("class")))
    return order.join(r, "class").groupBy("c_custkey", "method").agg(F.min_by("type", "depth").alias("type"))


@register("invocant_ladder", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'asserted' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'first_param' END, CASE WHEN c_acctbal > 0 THEN c_mktsegment END) AS type FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def invocant_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Ordered fallbacks for a receiver's type."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "left")
    rungs = F.when(F.col("o_orderstatus") == "F", "asserted"), F.when(F.col("o_orderpriority") == "1-URGENT", "first_param"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))
    return j.select("o_orderkey", F.coalesce(*rungs).alias("type"))


@register("arity_guard", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN coalesce(h = 0, false) WHEN 1 THEN coalesce(h = 3, false) WHEN 2 THEN coalesce(h >= 3, false) WHEN 3 THEN coalesce(h <= 3, false) ELSE true END AS takes FROM (SELECT *, CASE WHEN l_quantity < 40 THEN CAST(l_quantity AS INT) % 7 END AS h FROM lineitem)")
def arity_guard(spark: SparkSession, d: str) -> DataFrame:
    """Five guards against a number of arguments that may be unknown."""
    k = F.col("l_linenumber") % 5
    kind = F.when(k == 0, "empty").when(k == 1, "exact").when(k == 2, "at_least").when(k == 3, "at_most").otherwise("any")
    hint = F.when(F.col("l_quantity") < 40, F.col("l_quantity").cast("int") % 7)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", E.arity_guard(kind, F.lit(3), hint).alias("takes"))


@register("overload_rank", "WITH f AS (SELECT p_partkey, p_brand, CASE WHEN p_size = 5 THEN 0 WHEN p_size > 5 AND 5 >= 2 THEN 1 WHEN p_size % 2 = 0 AND 5 >= 2 THEN 2 ELSE 3 END AS fit FROM part) SELECT p_brand, p_partkey, fit, rank() OVER (PARTITION BY p_brand ORDER BY fit) AS rank FROM f QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY fit) = 1")
def overload_rank(spark: SparkSession, d: str) -> DataFrame:
    """The overloads of a name that fit a call of five arguments best: an aggregate finds the best fit, a join its holders."""
    fit = E.arity_fit(F.lit(5), F.col("p_size"), F.lit(2), F.col("p_size") % 2 == 0)
    p = table(spark, d, "part").select("p_brand", "p_partkey", fit.alias("fit"))
    best = p.groupBy("p_brand").agg(F.min("fit").alias("fit"))
    return p.join(best, ["p_brand", "fit"]).select("p_brand", "p_partkey", "fit", F.lit(1).alias("rank"))


@register("mutated_keys", f"WITH {W_SQL} SELECT att // 1000 AS class, list_sort(list(DISTINCT event_type)) AS keys FROM w WHERE priority >= 20 GROUP BY ALL")
def mutated_keys(spark: SparkSession, d: str) -> DataFrame:
    w = witnesses(spark, d).where("priority >= 20")
    return w.groupBy(F.floor(F.col("att") / 1000).alias("class")).agg(F.sort_array(F.collect_set("event_type")).alias("keys"))


@register("shape_last_write", f"WITH {W_SQL}, l AS (SELECT att // 1000 AS class, event_type AS k, arg_max(coalesce(type, 'Undef'), seq) AS t FROM w GROUP BY ALL) SELECT class, string_agg(k || '=' || t, ',' ORDER BY k) AS shape, count(*) < 5 AS open FROM l GROUP BY class")
def shape_last_write(spark: SparkSession, d: str) -> DataFrame:
    """Record shape per class, the last write of each key winning."""
    w = witnesses(spark, d).groupBy(F.floor(F.col("att") / 1000).alias("class"), F.col("event_type").alias("k")).agg(F.max_by(F.coalesce("type", F.lit("Undef")), "seq").alias("t"))
    cells = F.array_sort(F.collect_list(F.struct("k", "t")))
    return w.groupBy("class").agg(F.array_join(F.transform(cells, lambda x: F.concat(x["k"], F.lit("="), x["t"])), ",").alias("shape"), (F.count("*") < 5).alias("open"))
