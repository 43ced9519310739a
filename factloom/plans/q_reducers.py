"""Return expressions and the whole ladder of reducers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators import reducers as R
from factloom.operators.graph import kept
from factloom.plans.registry import register
from factloom.sources.facts import table

#: A node's number is its part's times eight and its place in the tree.
STEP = 8


def declared(spark: SparkSession, d: str) -> DataFrame:
    """The return expression that each part declares: five shapes, by its size."""
    p, s = F.col("p_partkey").cast("long") * STEP, F.col("p_size") % 5
    kid = lambda at, guard="any", n=0: F.struct(F.lit(guard).alias("guard"), F.lit(n).alias("n"), (p + at).alias("node"))
    no = F.lit(None)

    def node(at: int, op: str, type_=no, i=no, kids=None):
        return F.struct((p + at).alias("node"), F.lit(op).alias("op"), type_.cast("string").alias("type"), i.cast("int").alias("i"), (F.array() if kids is None else F.array(*kids)).cast("array<struct<guard:string,n:int,node:long>>").alias("kids"))

    own = F.concat(F.lit("Class:"), "p_brand")
    shapes = [
        F.array(node(0, "union", kids=[kid(1, "empty"), kid(2, "at_least", 1)]), node(1, "concrete", own), node(2, "receiver")),
        F.array(node(0, "row_of", kids=[kid(1)]), node(1, "receiver")),
        F.array(node(0, "param_of", i=F.lit(1), kids=[kid(1)]), node(1, "instance_of", F.lit("Box"), kids=[kid(2), kid(3)]), node(2, "receiver_or", F.lit("Any")), node(3, "arg", i=F.lit(0))),
        F.array(node(0, "union", kids=[kid(1, "exact", 2), kid(2, "any")]), node(1, "arg", i=F.lit(1)), node(2, "union", kids=[kid(3, "at_most", 1)]), node(3, "concrete", F.lit("Numeric"))),
        F.array(node(0, "instance_of", F.lit("Pair"), kids=[kid(1), kid(2)]), node(1, "receiver"), node(2, "row_of", kids=[kid(1)])),
    ]
    rows = F.when(s == 0, shapes[0]).when(s == 1, shapes[1]).when(s == 2, shapes[2]).when(s == 3, shapes[3]).otherwise(shapes[4])
    return table(spark, d, "part").select(F.inline(rows))


CALLS_SQL = """q AS (SELECT l_orderkey * 10 + l_linenumber AS id, p_size % 5 AS shape, p_brand,
  CASE l_linenumber % 3 WHEN 0 THEN 'ResultSet<Base,Row' || l_suppkey || '>' WHEN 1 THEN 'Class:S' || l_suppkey END AS receiver,
  CASE WHEN l_quantity < 40 THEN CAST(l_quantity AS INT) % 4 END AS arity, 'Class:' || l_linestatus AS arg0, 'Class:' || l_returnflag AS arg1, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey),
w AS (SELECT *, CASE WHEN arity >= 1 THEN arg0 END AS a0, CASE WHEN arity >= 2 THEN arg1 END AS a1, CASE WHEN receiver LIKE 'ResultSet%' THEN 'Class:Row' || l_suppkey END AS row FROM q)"""


@register("return_expressions", f"""WITH {CALLS_SQL} SELECT id, CASE shape
  WHEN 0 THEN CASE WHEN coalesce(arity, 0) = 0 THEN 'Class:' || p_brand ELSE receiver END
  WHEN 1 THEN row
  WHEN 2 THEN replace(a0, 'Class:', '')
  WHEN 3 THEN CASE WHEN arity = 2 THEN a1 WHEN arity <= 1 THEN 'Numeric' END
  ELSE 'Pair<' || replace(receiver, 'Class:', '') || ',' || replace(row, 'Class:', '') || '>' END AS type FROM w""")
def return_expressions(spark: SparkSession, d: str) -> DataFrame:
    """What each order line's call of its part gives: the part's return expression for the receiver and the arguments of the call."""
    li = table(spark, d, "lineitem")
    n = F.col("l_linenumber") % 3
    receiver = F.when(n == 0, R.result_set(F.lit("Base"), F.concat(F.lit("Row"), F.col("l_suppkey").cast("string")))).when(n == 1, F.concat(F.lit("Class:S"), F.col("l_suppkey").cast("string")))
    arity = F.when(F.col("l_quantity") < 40, F.col("l_quantity").cast("int") % 4)
    args = F.slice(F.array(F.concat(F.lit("Class:"), "l_linestatus"), F.concat(F.lit("Class:"), "l_returnflag")), F.lit(1), F.least(F.coalesce(arity, F.lit(0)), F.lit(2)))
    calls = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey").cast("long") * STEP).alias("root"), receiver.alias("receiver"), args.alias("args"), arity.alias("arity"))
    return R.evaluate(calls, kept(declared(spark, d)))


#: Kinds of attachments in turn, and the evidence of an event; a type and an observation alternate on variables.
KINDS = ("symbol", "package_symbol", "expr", "variable", "return_arm", "slot", "branch", "type_name", "domain")
OBSERVED = ("class", "first_param", "hash_access", "array_access", "bless", "regexp", "numeric", "string")
TYPES = ("Numeric", "Bool", "HashRef", "Class:Foo", None, "ArrayRef", "Hash{k}", "Class:Bar", "Brand:R", "FirstParam:P")
_listed = lambda xs: "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in xs) + "]"
BAG_SQL = f"""b AS (SELECT user_id * 100 + (event_id % 37) AS att, ({_listed(KINDS)})[(user_id * 100 + event_id % 37) % {len(KINDS)} + 1] AS kind, event_id AS seq, CAST(floor(value) AS INT) AS v,
    CASE event_type WHEN 'error' THEN 100 WHEN 'purchase' THEN 20 ELSE 10 END AS priority, event_type = 'view' AS fallback FROM events),
w AS (SELECT att, kind, seq, priority, fallback, CASE WHEN kind IN ('symbol', 'package_symbol', 'expr') AND v % 6 = 5 THEN 'return_expr' WHEN kind = 'variable' AND v % 11 = 10 THEN 'return_expr' WHEN kind = 'variable' AND v % 3 = 2 THEN 'observation' ELSE 'type' END AS payload,
    ({_listed(TYPES)})[v % {len(TYPES)} + 1] AS type0, ({_listed(OBSERVED)})[v % {len(OBSERVED)} + 1] AS observed, v % 50 AS start, v % 50 + CASE WHEN v % 4 = 0 THEN v % 30 ELSE 0 END AS stop, CASE WHEN att % 2 = 0 THEN 35 END AS point FROM b),
x AS (SELECT *, CASE WHEN payload <> 'observation' THEN type0 WHEN observed IN ('class', 'first_param') THEN 'Class:Obs' WHEN observed = 'bless' THEN 'HashRef' END AS type FROM w),
e AS (SELECT *, CASE WHEN payload = 'type' THEN type END AS t, kind <> 'variable' OR point IS NULL OR (start <= point AND (payload <> 'type' OR stop <= start OR point BETWEEN start AND stop)) AS alive FROM x)"""
_AGREE = "CASE WHEN min(t) = max(t) THEN min(t) WHEN bool_and(starts_with(t, 'Hash')) THEN 'HashRef' WHEN bool_and(starts_with(t, 'Array') OR starts_with(t, 'Sequence')) THEN 'ArrayRef' WHEN bool_and(t IN ('Bool', 'Numeric')) THEN 'Numeric' WHEN bool_and(starts_with(t, 'Class:') OR starts_with(t, 'Hash')) THEN arg_max(t, seq) FILTER (starts_with(t, 'Class:')) END"
_PLAIN = "alive AND payload = 'type' AND NOT starts_with(type, 'Class:') AND NOT starts_with(type, 'Brand:') AND NOT starts_with(type, 'FirstParam:')"
LADDER_SQL = f"""WITH {BAG_SQL}, r AS (SELECT att, min(kind) AS kind, arg_max(t, (priority, seq)) FILTER (t IS NOT NULL AND priority > 10) AS plugin,
    arg_max({{'t': type}}, (priority, seq)) FILTER (payload = 'return_expr' AND (kind <> 'variable' OR point IS NULL OR start <= point)) AS deferred,
    {_AGREE} AS agreed, bool_or(t IS NULL) AS undef, count(DISTINCT t) FILTER (starts_with(t, 'Class:')) AS n_classes, min(t) AS low, max(t) AS high, count(*) AS n, arg_min(t, seq) FILTER (t IS NOT NULL AND fallback) AS floor,
    arg_max(t, seq) FILTER (t IS NOT NULL) AS last,
    arg_min(type, (stop - start, seq)) FILTER (payload = 'type' AND type IS NOT NULL AND point IS NOT NULL AND stop > start AND point BETWEEN start AND stop) AS narrow,
    bool_or(payload = 'type' AND point IS NOT NULL AND stop > start AND point BETWEEN start AND stop AND type IS NOT NULL) AS narrowed,
    arg_max(type, seq) FILTER (alive AND payload = 'type' AND starts_with(type, 'Brand:')) AS brand,
    arg_max(type, (priority, seq)) FILTER (alive AND (payload = 'type' AND starts_with(type, 'Class:') OR payload = 'observation' AND observed = 'class')) AS asserted,
    arg_max(type, seq) FILTER (alive AND (payload = 'type' AND starts_with(type, 'FirstParam:') OR payload = 'observation' AND observed = 'first_param')) AS first,
    arg_max(type, (priority, seq)) FILTER ({_PLAIN} AND type IS NOT NULL) AS plain, max(priority) FILTER ({_PLAIN} AND type IS NOT NULL) AS plain_p,
    arg_max(type, (priority, seq)) FILTER ({_PLAIN} AND type <> 'HashRef') AS other, max(priority) FILTER ({_PLAIN} AND type <> 'HashRef') AS other_p,
    arg_max(CASE observed WHEN 'hash_access' THEN 'HashRef' ELSE 'ArrayRef' END, seq) FILTER (alive AND payload = 'observation' AND observed IN ('hash_access', 'array_access')) AS used,
    bool_or(alive AND payload = 'observation' AND observed = 'bless') AS blessed, bool_or(alive AND payload = 'observation' AND observed = 'regexp') AS re, bool_or(alive AND payload = 'observation' AND observed = 'numeric') AS num, bool_or(alive AND payload = 'observation' AND observed = 'string') AS str
    FROM e WHERE kind <> 'domain' GROUP BY att),
f AS (SELECT *, coalesce(narrow, brand, asserted, 'Class:' || regexp_replace(first, '^(FirstParam|Class):', ''), CASE WHEN plain = 'HashRef' AND starts_with(other, 'Hash{{') AND other_p = plain_p THEN other ELSE plain END, used, CASE WHEN blessed THEN 'HashRef' END, CASE WHEN re THEN 'Regexp' END, CASE WHEN num THEN 'Numeric' END, CASE WHEN str THEN 'String' END) AS framework FROM r),
l AS (SELECT att, [{{'type': CASE WHEN kind = 'symbol' THEN plugin END, 'reducer': 'plugin_override'}}, {{'type': CASE WHEN kind IN ('symbol', 'package_symbol', 'expr', 'variable') THEN deferred.t END, 'reducer': 'return_expr'}},
    {{'type': CASE WHEN kind = 'return_arm' THEN CASE WHEN undef THEN 'Optional<' || agreed || '>' ELSE agreed END END, 'reducer': 'return_arms'}}, {{'type': CASE WHEN kind = 'slot' AND n_classes <= 1 THEN agreed END, 'reducer': 'slot'}},
    {{'type': CASE WHEN kind = 'branch' THEN CASE WHEN floor IS NOT NULL THEN CASE WHEN low = high THEN low ELSE floor END WHEN n >= 2 AND low = high THEN CASE WHEN undef THEN 'Optional<' || low || '>' ELSE low END END END, 'reducer': 'branch'}},
    {{'type': CASE WHEN kind = 'variable' THEN framework END, 'reducer': 'framework'}}, {{'type': CASE WHEN kind = 'expr' THEN last END, 'reducer': 'expr'}}, {{'type': CASE WHEN kind = 'package_symbol' THEN last END, 'reducer': 'package_symbol'}},
    {{'type': CASE WHEN kind = 'type_name' THEN last END, 'reducer': 'type_name'}}, {{'type': CASE WHEN kind = 'symbol' THEN last END, 'reducer': 'sub_return'}}] AS xs FROM f),
o AS (SELECT att, list_filter(xs, lambda x: x.type IS NOT NULL)[1] AS x FROM l),
v AS (SELECT att, type, count(*) AS n FROM e WHERE kind = 'domain' GROUP BY ALL), d AS (SELECT att, sum(n) AS total FROM v GROUP BY att)
SELECT att, x.type AS type, x.reducer AS reducer FROM o WHERE x IS NOT NULL UNION ALL SELECT att, type, 'domain' FROM v JOIN d USING (att) WHERE total >= 2 AND 2 * n > total AND type IS NOT NULL"""


@register("reducers_in_order", LADDER_SQL)
def reducers_in_order(spark: SparkSession, d: str) -> DataFrame:
    """All eleven reducers over events as evidence on nine kinds of attachments, with the one that answered."""
    e, v = table(spark, d, "events"), F.floor("value").cast("int")
    att = F.col("user_id") * 100 + F.col("event_id") % 37
    among = lambda xs, i: F.element_at(F.array(*[F.lit(x).cast("string") for x in xs]), (i % len(xs) + 1).cast("int"))
    priority = F.when(F.col("event_type") == "error", 100).when(F.col("event_type") == "purchase", 20).otherwise(10)
    b = e.select(att.alias("att"), among(KINDS, att).alias("kind"), F.col("event_id").alias("seq"), v.alias("v"), priority.alias("priority"), (F.col("event_type") == "view").alias("fallback"))
    named, n = F.col("kind").isin("symbol", "package_symbol", "expr"), F.col("v")
    payload = F.when(named & (n % 6 == 5), "return_expr").when((F.col("kind") == "variable") & (n % 11 == 10), "return_expr").when((F.col("kind") == "variable") & (n % 3 == 2), "observation").otherwise("type")
    b = b.withColumn("payload", payload).withColumn("observed", among(OBSERVED, n)).withColumn("start", n % 50).withColumn("stop", n % 50 + F.when(n % 4 == 0, n % 30).otherwise(0))
    seen = F.when(F.col("observed").isin("class", "first_param"), "Class:Obs").when(F.col("observed") == "bless", "HashRef")
    b = b.withColumn("type", F.when(F.col("payload") != "observation", among(TYPES, n)).otherwise(seen)).withColumn("point", F.when(F.col("att") % 2 == 0, 35))
    return R.reduced(b)
