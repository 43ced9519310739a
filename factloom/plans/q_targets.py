"""Targets and their uses, owners, enumerators, member operators, bounded lookups, stubs and bundled plugins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions import plugins as P
from factloom.operators import extract as X, navigate as N, targets as T
from factloom.operators.graph import closure, kept
from factloom.operators.statements import normal_forms
from factloom.plans.q_extract import rows, sql
from factloom.plans.registry import register
from factloom.session import shared_folder
from factloom.sources import code, facts
from factloom.sources.facts import SYMS_SQL, table


def _ancestors(r: DataFrame, classes: DataFrame) -> DataFrame:
    return closure(X.inherits(r), classes.distinct().toDF("origin"), include_self=True)


def _targets(spark: SparkSession, d: str, each: str) -> DataFrame:
    """target, kind, name, package of every customer, from a SQL list of (kind, name, package) over k and n."""
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    one = base.select(F.expr(f"inline(array({each}))"))
    return one.toDF("kind", "name", "package").distinct().select(F.concat_ws(" ", "kind", "package", "name").alias("target"), "kind", "name", "package")


DEFINED = """struct('sub', concat('stop_', n), concat('Shop::C', k)), struct('method', concat('base_', n), concat('Shop::C', k)),
struct('method', concat('run_', k), concat('Shop::N', n)), struct('package', concat('Shop::N', n), ''), struct('variable', '@EXPORT_OK', concat('Shop::C', k)),
struct('variable', '$copy', concat('Shop::C', k))"""


@register("symbol_defines_target", sql(
    "SELECT 'sub Shop::C' || k || ' stop_' || n AS target, k AS file_id, 42 AS line FROM c",
    "SELECT 'method Shop::C' || k || ' base_' || n, -1 - n::BIGINT, 2 FROM c",
    "SELECT DISTINCT 'package  Shop::N' || c_nationkey, -1 - c_nationkey::BIGINT, 0 FROM customer",
    "SELECT 'variable Shop::C' || k || ' @EXPORT_OK', k, 6 FROM c"))
def symbol_defines_target(spark: SparkSession, d: str) -> DataFrame:
    """Declarations by kind of target: neither a class's sub in its parent nor a variable of a sub is one."""
    r = kept(rows(spark, d))
    targets = _targets(spark, d, DEFINED)
    return T.defining(targets, X.declarations(r), _ancestors(r, targets.where("kind = 'method'").select("package")))


MATCHED = """struct('sub', concat('load_', n), 'Shop::Util'), struct('sub', concat('log_', n), 'Shop::Util'), struct('method', concat('stop_', n), concat('Shop::C', k)),
struct('method', 'on', concat('Shop::N', n)), struct('method', 'pay', 'Shop::R'), struct('method', 'pay', concat('Shop::C', k)), struct('package', concat('Shop::N', n), '')"""


@register("ref_matches_target", sql(
    "SELECT 'sub Shop::Util load_' || n AS target, k AS file_id, 23 AS line, 'function' AS arm FROM c",
    "SELECT 'sub Shop::Util log_' || n, k, 31, 'qualified' FROM c",
    "SELECT 'method Shop::C' || k || ' stop_' || n, k, 24, 'method' FROM c",
    "SELECT 'method Shop::N' || n || ' on', k, 38, 'method' FROM c",
    "SELECT 'method Shop::R pay', k, 35, 'method' FROM c",
    "SELECT 'package  Shop::N' || n, k, 3, 'package' FROM c"))
def ref_matches_target(spark: SparkSession, d: str) -> DataFrame:
    """Uses by kind: a method's only where the receiver's class is the target's or descends from it."""
    r = kept(rows(spark, d))
    found, used = X.calls(r), X.uses(r)
    sent = kept(N.stamped_calls(r))
    up = _ancestors(r, sent.where("class is not null").select("class"))
    return T.matching(_targets(spark, d, MATCHED), X.pinned_calls(found, X.declarations(r), used), found, sent, used, up)


@register("key_owner_match", """WITH defs AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber = 7 THEN 'class' ELSE 'sub' END AS owner, CASE WHEN l_quantity >= 5 THEN l_suppkey END AS package,
  CASE WHEN l_linenumber = 7 THEN '' ELSE 'm' || l_linenumber END AS sub, l_returnflag || l_linestatus AS key FROM lineitem),
lookups AS (SELECT s_suppkey AS package, x.owner, x.sub, x.key FROM supplier, LATERAL (VALUES ('class', '', 'RF'), ('sub', 'm1', 'RF'), ('sub', 'm2', 'NO')) AS x(owner, sub, key))
SELECT l.owner, l.package, l.sub, l.key, count(*) AS n, min(id) AS first FROM lookups l JOIN defs f ON l.key = f.key AND l.package = f.package
  AND ((l.owner = f.owner AND l.sub = f.sub) OR (l.owner = 'class' AND f.owner = 'sub')) GROUP BY ALL""")
def key_owner_match(spark: SparkSession, d: str) -> DataFrame:
    """A lookup by class finds the keys of its subs, one by sub only those of that sub."""
    last = F.col("l_linenumber") == 7
    defs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(last, "class").otherwise("sub").alias("owner"), F.when(F.col("l_quantity") >= 5, F.col("l_suppkey")).alias("package"), F.when(last, "").otherwise(F.concat(F.lit("m"), F.col("l_linenumber").cast("string"))).alias("sub"), F.concat("l_returnflag", "l_linestatus").alias("key"))
    asked = "inline(array(struct('class', '', 'RF'), struct('sub', 'm1', 'RF'), struct('sub', 'm2', 'NO')))"
    lookups = table(spark, d, "supplier").select(F.col("s_suppkey").alias("package"), F.expr(asked)).toDF("package", "owner", "sub", "key")
    return T.found_by(defs, lookups).groupBy("owner", "package", "sub", "key").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@register("budgeted_lookup", """WITH once AS (SELECT l_orderkey AS query, l_suppkey AS name, min(l_linenumber) AS first FROM lineitem GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY first, name) AS place, count(*) OVER (PARTITION BY query) > 3 AS degraded FROM once)
SELECT query, name, s_name AS answer, degraded FROM p LEFT JOIN supplier ON name = s_suppkey AND place <= 3 AND s_suppkey % 3 <> 0""")
def budgeted_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("seq"), F.col("l_suppkey").alias("name"))
    known = table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("name"), F.col("s_name").alias("answer"))
    return T.budgeted(asked, known, 3)


ENUM_SQL = """s AS (SELECT p_size AS file_id, p_type AS name, CASE WHEN p_partkey % 3 = 0 THEN 'Enumerator' WHEN p_partkey % 3 = 1 THEN 'Sub' ELSE 'Field' END AS kind, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS package, p_partkey AS ord FROM part),
h AS (SELECT file_id, name, first(package ORDER BY ord, package) AS package FROM s WHERE kind <> 'Sub' AND package IS NOT NULL GROUP BY ALL),
o AS (SELECT name, first(package ORDER BY file_id) AS package FROM h GROUP BY ALL),
a AS (SELECT DISTINCT p_size + 1 AS file_id, p_type AS value FROM part),
e AS (SELECT a.file_id, value, coalesce(h.package, o.package) AS enum FROM a LEFT JOIN h ON h.file_id = a.file_id AND h.name = value LEFT JOIN o ON o.name = value),
m AS (SELECT file_id, package, list(name ORDER BY ord) AS l FROM s WHERE kind = 'Enumerator' AND package IS NOT NULL GROUP BY ALL),
mo AS (SELECT package, first(l ORDER BY file_id) AS l FROM m GROUP BY ALL)"""


@register("domain_members", f"WITH {ENUM_SQL} SELECT e.file_id, value, enum, array_to_string(coalesce(m.l, mo.l, []), '|') AS members FROM e LEFT JOIN m ON m.file_id = e.file_id AND m.package = enum LEFT JOIN mo ON mo.package = enum")
def domain_members(spark: SparkSession, d: str) -> DataFrame:
    """From a value to its enum, and from there to the enum's members."""
    kind = F.when(F.col("p_partkey") % 3 == 0, "Enumerator").when(F.col("p_partkey") % 3 == 1, "Sub").otherwise("Field")
    symbols = table(spark, d, "part").select(F.col("p_size").alias("file_id"), F.col("p_type").alias("name"), kind.alias("kind"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("package"), F.col("p_partkey").alias("ord"))
    values = table(spark, d, "part").select((F.col("p_size") + 1).alias("file_id"), F.col("p_type").alias("value")).distinct()
    of = T.enum_of(values, symbols)
    members = T.enum_members(of.where("enum is not null").select("file_id", "enum").distinct(), symbols)
    return of.join(members, ["file_id", "enum"], "left").select("file_id", "value", "enum", F.coalesce(F.array_join("members", "|"), F.lit("")).alias("members"))


@register("reduce_type_name", "SELECT 'T' || o_custkey AS att_key, first(o_orderpriority ORDER BY o_orderkey DESC) AS type FROM orders WHERE o_orderkey % 4 <> 1 AND o_orderstatus <> 'P' GROUP BY 1")
def reduce_type_name(spark: SparkSession, d: str) -> DataFrame:
    """The latest type that a name is an alias of; a witness without a type, or of another kind, doesn't count."""
    o = table(spark, d, "orders")
    w = o.select(F.when(F.col("o_orderkey") % 4 == 1, "Variable").otherwise("TypeName").alias("att_type"), F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("att_key"), F.lit("InferredType").alias("payload_type"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("payload"), F.col("o_orderkey").alias("seq"))
    return T.alias_types(w)


OPERATORS = f"""(5, 'v', '{T.MEMBER_OPERATOR}', '->', '.'), (6, 'p', '{T.MEMBER_OPERATOR}', '.', '->'), (7, 'q', '{T.MEMBER_PEEL}', '->', '(*q)->'),
(7, 'r', '{T.MEMBER_OPERATOR}', '->', '.'), (9, 'p', '{T.MEMBER_OPERATOR}', '->', '.')"""


@register("member_operators", f"SELECT s_suppkey::BIGINT AS file_id, x.* FROM supplier, LATERAL (VALUES {OPERATORS}) AS x(line, var, rule, written, fix)")
def member_operators(spark: SparkSession, d: str) -> DataFrame:
    return T.member_operators(X.lines(code.accesses(spark, d)))


@register("deferred_owners", """SELECT l_orderkey AS ref, l_linenumber AS line, coalesce(CASE WHEN l_returnflag = 'R' THEN 'own' END, CASE WHEN s_suppkey IS NOT NULL AND l_linestatus = 'O' THEN 'C' || l_suppkey END, 'C' || l_suppkey || '::' || CASE l_linestatus WHEN 'O' THEN 'search' ELSE 'get' END) AS owner
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND l_linenumber = s_nationkey % 7""")
def deferred_owners(spark: SparkSession, d: str) -> DataFrame:
    """Owners of keys that a file alone doesn't tell: a column of the class, or the result of the call."""
    of = lambda c: F.concat(F.lit("C"), F.col(c).cast("string"))
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ref"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "R", "own").alias("owner"), of("l_suppkey").alias("class"), F.when(F.col("l_linestatus") == "O", "search").otherwise("get").alias("verb"), F.col("l_linenumber").alias("key"))
    columns = table(spark, d, "supplier").select(of("s_suppkey").alias("class"), (F.col("s_nationkey") % 7).alias("key"))
    return T.deferred_owners(refs, columns, ("search",)).select("ref", "line", "owner")


@register("byte_capped_cache", """WITH t AS (SELECT c_nationkey AS cache, o_custkey AS path, max(o_orderkey) AS seq, (o_custkey % 50 + 1) * 100 AS bytes FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT cache, path FROM t WINDOW w AS (PARTITION BY cache ORDER BY seq DESC, path ROWS UNBOUNDED PRECEDING) QUALIFY sum(bytes) OVER w <= 6000 OR row_number() OVER w = 1""")
def byte_capped_cache(spark: SparkSession, d: str) -> DataFrame:
    """What the caches of all nations hold after the orders of their customers."""
    owner = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("cache"))
    o = table(spark, d, "orders").join(owner, "o_custkey")
    return T.resident(o.select("cache", F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("seq"), ((F.col("o_custkey") % 50 + 1) * 100).alias("bytes")), 6000)


@register("stable_outline", """WITH RECURSIVE v AS (SELECT o_custkey AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey % 5 + 1 AS m, o_orderkey % 7 AS t FROM orders),
r AS (SELECT f, i, m AS held FROM v WHERE i = 1 UNION ALL SELECT v.f, v.i, CASE WHEN v.m >= held THEN v.m ELSE least(held, v.t) END FROM r JOIN v ON v.f = r.f AND v.i = r.i + 1)
SELECT f AS file_id, array_to_string(['s' || x FOR x IN range(0, max_by(held, i)::INT)], ',') AS outline FROM r GROUP BY f""")
def stable_outline(spark: SparkSession, d: str) -> DataFrame:
    """Outlines of documents that are edited while they don't always parse: version by version."""
    upto = lambda n: F.transform(F.sequence(F.lit(0), n.cast("int")), lambda x: F.concat(F.lit("s"), x.cast("string")))
    k = F.col("o_orderkey")
    versions = table(spark, d, "orders").select(F.col("o_custkey").alias("file_id"), k.alias("version"), upto(k % 5).alias("names"), F.slice(upto(k % 7), F.lit(1), (k % 7).cast("int")).alias("words"))
    return T.stable_outline(versions).select("file_id", F.array_join("outline", ",").alias("outline"))


VERBS = (("on", "dispatch", "Shop::N3"), ("pay", "column-keyed", None), ("owner", "fluent", None), ("new", "load", "Shop::None"))


@register("verb_manifest", sql("SELECT k AS file_id, x.* FROM c, LATERAL (VALUES (33, 'owner', 'fluent'), (35, 'pay', 'column-keyed')) AS x(line, name, role)", "SELECT k, 38, 'on', 'dispatch' FROM c WHERE n = 3"))
def verb_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Roles of verbs that a manifest declares, some only on classes that descend from the gate's."""
    r = kept(rows(spark, d))
    sent = kept(N.stamped_calls(r))
    return T.verb_roles(sent, _ancestors(r, sent.where("class is not null").select("class")), VERBS)


@register("bundled_plugins", """SELECT x.plugin, c_custkey AS file_id, x.pattern, x.kind, x.name FROM customer, LATERAL (VALUES ('events', 'handler', 'Handler', 'event_' || c_nationkey), ('accessors', 'has', 'Method', 'color_' || c_nationkey),
  ('accessors', 'has', 'Method', 'owner'), ('parents', 'parent', 'PackageParent', 'Shop::N' || c_nationkey)) AS x(plugin, pattern, kind, name)
UNION ALL SELECT 'accessors', -1 - n_nationkey::BIGINT, 'has', 'Method', 'boss' FROM nation""")
def bundled_plugins(spark: SparkSession, d: str) -> DataFrame:
    return P.run_all(normal_forms(code.programs(spark, d).select("file_id", "text")))


@register("name_keyed_warm_scan", f"WITH {SYMS_SQL} SELECT key AS name, s.file_id, row_number() OVER (PARTITION BY key ORDER BY CASE f.source WHEN 'workspace' THEN 0 ELSE 1 END, s.file_id) = 1 AS wins FROM syms s JOIN files f ON s.file_id = f.file_id")
def name_keyed_warm_scan(spark: SparkSession, d: str) -> DataFrame:
    """The slots of all names, with the providers that didn't win."""
    s = facts.syms(spark, d).join(facts.files(spark, d).select("file_id", "source"), "file_id").select(F.col("key").alias("name"), "file_id", "source")
    return T.providers_by_name(s, [F.when(F.col("source") == "workspace", 0).otherwise(1), F.col("file_id")])


@register("warm_stub_register", f"WITH {SYMS_SQL}, n AS (SELECT file_id, count(*) AS n_symbols FROM syms GROUP BY file_id) SELECT file_id, path, CASE WHEN file_id % 5 <> 0 THEN n_symbols END AS n_symbols, file_id % 5 <> 0 AND n_symbols IS NOT NULL AS warm FROM files LEFT JOIN n USING (file_id)")
def warm_stub_register(spark: SparkSession, d: str) -> DataFrame:
    """Stubs written once, then read instead of the files; every fifth file has changed since."""
    path = f"{shared_folder(spark)}/stubs-{uuid.uuid4().hex}"
    files = facts.files(spark, d).select("file_id", "path")
    counts = facts.syms(spark, d).groupBy("file_id").agg(F.count("*").alias("n_symbols"))
    files.join(counts, "file_id").select("path", F.lit(0).alias("stamp"), "n_symbols").write.parquet(path)
    now = files.withColumn("stamp", F.when(F.col("file_id") % 5 == 0, 1).otherwise(0))
    return T.registered(spark.read.parquet(path), now)
