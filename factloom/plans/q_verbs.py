"""Verbs and diagnostic rules, bound to the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from factloom.model import ROLES
from factloom.operators import graph as G, rules as U, verbs as V
from factloom.plans.q_graph import H_SQL, hierarchy
from factloom.plans.registry import register
from factloom.sources import facts
from factloom.sources.facts import FILES_SQL, SYMS_SQL, table

TARGET_KEYS = ((1, "that"), (2, "with"), (3, "aulich"), (4, "zzzz"))
TARGETS = ", ".join(f"({i}, '{k}')" for i, k in TARGET_KEYS)
REF_SQL = f"""WITH {SYMS_SQL}, t(target, key) AS (VALUES {TARGETS}), d AS (SELECT target, s.file_id, s.start_at AS pos FROM syms s JOIN t USING (key) JOIN files f ON s.file_id = f.file_id WHERE f.source = 'workspace'),
u AS (SELECT target, o.file_id, o.pos FROM occ o JOIN t USING (key) JOIN files f ON o.file_id = f.file_id WHERE f.source = 'workspace'),
r AS (SELECT u.target, u.file_id, u.pos, CASE WHEN d.pos IS NULL THEN 0 ELSE 2 END AS access FROM u LEFT JOIN d ON u.target = d.target AND u.file_id = d.file_id AND u.pos = d.pos)"""


def _references(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.sql(f"SELECT * FROM VALUES {TARGETS} AS t(target, key)")
    f = facts.files(spark, d).select("file_id", F.when(F.col("source") == "workspace", ROLES["workspace"]).otherwise(ROLES["dependency"]).alias("role"))
    keys = tuple(k for _, k in TARGET_KEYS)
    sites = facts.occurrences(spark, d, keys=keys).withColumn("access", F.lit(0))
    decl = facts.syms(spark, d, keys).select("file_id", "key", F.col("start_at").alias("pos"))
    return V.references(targets, None, sites, decl, f, ROLES["open"] | ROLES["workspace"])


@register("references", f"{REF_SQL} SELECT target, file_id, pos, access FROM r")
def references(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d)


@register("document_highlight", f"{REF_SQL} SELECT target, file_id, pos, access FROM r WHERE file_id IN (SELECT doc_id FROM labels)")
def document_highlight(spark: SparkSession, d: str) -> DataFrame:
    """The places of each target in the files that are asked for: all labelled ones."""
    asked = table(spark, d, "labels").select(F.col("doc_id").alias("file_id"))
    return V.highlights(_references(spark, d), asked).select("target", "file_id", "pos", "access")


@register("rename_edits", f"{REF_SQL} SELECT target, file_id, pos, 'renamed' AS new_text FROM r WHERE target NOT IN (SELECT target FROM r WHERE file_id % 97 = 5 AND pos % 11 = 3)")
def rename_edits(spark: SparkSession, d: str) -> DataFrame:
    """Edits of a rename; synthesised places may not be rewritten and refuse their target."""
    r = _references(spark, d)
    folded = r.where("file_id % 97 = 5 and pos % 11 = 3").select("target", "file_id", "pos", F.lit(False).alias("ok"))
    return V.rename_edits(r, folded, "renamed")


@register("references_parity", f"{REF_SQL} SELECT 'left' AS path, target, count(*) AS n FROM r GROUP BY target UNION ALL SELECT 'differences', 0, 0")
def references_parity(spark: SparkSession, d: str) -> DataFrame:
    """The indexed path against a full scan: counts, and the number of rows they don't share."""
    r = _references(spark, d)
    targets = spark.sql(f"SELECT * FROM VALUES {TARGETS} AS t(target, key)")
    work = facts.files(spark, d).where("source = 'workspace'").select("file_id")
    full = facts.occurrences(spark, d).join(F.broadcast(targets), "key").join(work, "file_id", "left_semi").select("target", "file_id", "pos")  # four literal rows
    diff = V.parity(r.select("target", "file_id", "pos"), full).agg(F.count("*").alias("n")).select(F.lit("differences").alias("path"), F.lit(0).alias("target"), "n")
    return r.groupBy("target").agg(F.count("*").alias("n")).select(F.lit("left").alias("path"), "target", "n").unionByName(diff)


@register("definition_lanes", f"WITH {SYMS_SQL}, l AS (SELECT key, file_id, CASE WHEN (flags & 8) <> 0 THEN 0 WHEN kind = 1 THEN 1 ELSE 2 END AS lane FROM syms) SELECT key, file_id, lane FROM l a WHERE lane = (SELECT min(lane) FROM l b WHERE b.key = a.key)")
def definition_lanes(spark: SparkSession, d: str) -> DataFrame:
    """Every definition in the best lane that has one."""
    s = facts.syms(spark, d)
    exported = F.col("flags").bitwiseAND(8) != 0
    lanes = [s.where(exported), s.where(~exported & (F.col("kind") == 1)), s.where(~exported & (F.col("kind") != 1))]
    return V.definition([x.select("key", "file_id") for x in lanes], ["key"]).select("key", "file_id", "lane")


@register("preferred_definition", "SELECT o_custkey, coalesce(min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END), min(o_orderkey)) AS definition FROM orders GROUP BY o_custkey")
def preferred_definition(spark: SparkSession, d: str) -> DataFrame:
    """Bodies replace prototypes."""
    body = F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.coalesce(body, F.min("o_orderkey")).alias("definition"))


@register("completion_sources", "WITH c AS (SELECT s_name AS label, 'sub' AS kind, s_nationkey AS priority, 0 AS source FROM supplier UNION ALL SELECT replace(c_name, 'Customer', 'Supplier'), 'import', c_nationkey, 1 FROM customer), w AS (SELECT label, min((source, priority, kind)) AS x FROM c WHERE starts_with(label, 'Supplier#0000000') GROUP BY label) SELECT label, x[3] AS kind, x[2] AS priority FROM w ORDER BY priority, label LIMIT 200")
def completion_sources(spark: SparkSession, d: str) -> DataFrame:
    """Local names shadow imported ones; ranked and cut."""
    local = table(spark, d, "supplier").select(F.col("s_name").alias("label"), F.lit("sub").alias("kind"), F.col("s_nationkey").alias("priority"))
    imported = table(spark, d, "customer").select(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("label"), F.lit("import").alias("kind"), F.col("c_nationkey").alias("priority"))
    return V.completion([local, imported], "Supplier#0000000")


@register("outline", f"WITH {SYMS_SQL}, k AS (SELECT file_id, kind, count(*) AS n, arg_min(key, start_at) AS first FROM syms GROUP BY ALL) SELECT file_id, sum(n)::BIGINT AS n, min(first) AS first FROM k GROUP BY file_id")
def outline(spark: SparkSession, d: str) -> DataFrame:
    o = V.outline(facts.syms(spark, d))
    return o.select("file_id", F.aggregate("outline", F.lit(0).cast("long"), lambda a, x: a + F.size(x["symbols"])).alias("n"), F.array_min(F.transform("outline", lambda x: x["symbols"][0]["key"])).alias("first"))


@register("semantic_tokens", f"WITH {SYMS_SQL} SELECT key, bit_or(1 << kind) AS modifiers FROM syms GROUP BY key")
def semantic_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Modifier bits of every name."""
    return facts.syms(spark, d).groupBy("key").agg(F.bit_or(F.expr("shiftleft(1, kind)")).alias("modifiers"))


@register("hover", f"WITH {SYMS_SQL} SELECT key, arg_min(s.file_id, (start_at, s.file_id)) AS file_id, count(*) AS n_candidates FROM syms s GROUP BY key")
def hover(spark: SparkSession, d: str) -> DataFrame:
    s = facts.syms(spark, d)
    return s.groupBy("key").agg(F.min_by("file_id", F.struct("start_at", "file_id")).alias("file_id"), F.count("*").alias("n_candidates"))


@register("code_actions", f"WITH {SYMS_SQL}, o AS (SELECT key, list_sort(list(DISTINCT file_id))[1:3] AS offers FROM syms WHERE (flags & 8) <> 0 GROUP BY key) SELECT r.file_id, r.key, offers FROM refs r JOIN o USING (key) ANTI JOIN syms s ON s.file_id = r.file_id AND s.key = r.key")
def code_actions(spark: SparkSession, d: str) -> DataFrame:
    """Exporters to import a name from, the first three of each, for every file that uses a name without declaring it."""
    s = facts.syms(spark, d)
    exporters = s.where(F.col("flags").bitwiseAND(8) != 0).select("key", "file_id").distinct()
    ranked = exporters.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("file_id"))).where("r <= 3")
    offers = ranked.groupBy("key").agg(F.sort_array(F.collect_list("file_id")).alias("offers"))
    # a file that declares at all declares every name it uses, so whole files fall out, before their texts are split
    docs = table(spark, d, "documents").join(facts.declaring(spark, d).select(F.col("file_id").alias("doc_id")), "doc_id", "left_anti")
    missing = docs.select(F.col("doc_id").alias("file_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(facts.TOKEN), F.lit(0)))).alias("key"))
    return missing.join(offers, "key").select("file_id", "key", "offers")


@register("batch_queries", f"WITH {SYMS_SQL}, q(id, q, file_id, query) AS (VALUES ('a', 'references', NULL, 'that'), ('b', 'symbols', 1, NULL), ('c', 'search', NULL, 'tiont')) SELECT q.id, count(*) AS n FROM q JOIN refs r ON q.q = 'references' AND r.key = q.query GROUP BY q.id UNION ALL SELECT q.id, count(*) FROM q JOIN syms s ON q.q = 'symbols' AND s.file_id = q.file_id GROUP BY q.id UNION ALL SELECT q.id, count(*) FROM q JOIN syms s ON q.q = 'search' AND contains(s.key, q.query) GROUP BY q.id")
def batch_queries(spark: SparkSession, d: str) -> DataFrame:
    """Many requests in one job: requests joined to the relations they ask."""
    lines = spark.sql("""SELECT * FROM VALUES ('{"id":"a","q":"references","query":"that"}'), ('{"id":"b","q":"symbols","file_id":1}'), ('{"id":"c","q":"search","query":"tiont"}') AS t(line)""")
    q = lines.select(F.from_json("line", "id string, q string, file_id long, query string").alias("x")).select("x.*")
    s = facts.syms(spark, d)
    count = lambda x: x.groupBy("id").agg(F.count("*").alias("n"))
    a = count(facts.refs(spark, d).join(F.broadcast(q.where("q = 'references'").select("id", F.col("query").alias("key"))), "key"))
    b = count(s.join(F.broadcast(q.where("q = 'symbols'").select("id", "file_id")), "file_id"))
    c = count(s.join(F.broadcast(q.where("q = 'search'").select("id", "query")), F.contains("key", F.col("query"))))  # requests are literal rows
    return a.unionByName(b).unionByName(c)


@register("group_references", "SELECT p_brand AS group_id, count(DISTINCT l_orderkey) AS n FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand")
def group_references(spark: SparkSession, d: str) -> DataFrame:
    """Uses of all members of a group."""
    members = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("group_id"))
    return table(spark, d, "lineitem").select("l_partkey", "l_orderkey").join(members, "l_partkey").groupBy("group_id").agg(F.count_distinct("l_orderkey").alias("n"))


@register("projection_group_rename", "SELECT p_partkey, 'has_' || lower(p_type) AS old, 'has_renamed' AS new FROM part UNION ALL SELECT p_partkey, lower(p_type), 'renamed' FROM part")
def projection_group_rename(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling of a group renamed with its own prefix."""
    prefix = F.explode(F.array(F.lit(""), F.lit("has_"))).alias("prefix")
    p = table(spark, d, "part").select("p_partkey", F.lower("p_type").alias("t"), prefix)
    return p.select("p_partkey", F.concat("prefix", "t").alias("old"), F.concat("prefix", F.lit("renamed")).alias("new"))


@register("package_variable_uses", f"""WITH {FILES_SQL}, l AS (SELECT doc_id AS file_id, regexp_extract_all(lower(text), '{facts.TOKEN}') AS l FROM documents WHERE contains(lower(text), 'that')),
p AS (SELECT file_id, list_filter(range(len(l)), lambda i: l[i + 1] = 'that') AS places FROM l)
SELECT 'decl' AS how, file_id, places[1] AS pos FROM p JOIN labels ON doc_id = file_id WHERE len(places) > 0
UNION ALL SELECT 'same_lang', file_id, unnest(places) FROM p JOIN files USING (file_id) WHERE lang = 'en' AND source = 'workspace'""")
def package_variable_uses(spark: SparkSession, d: str) -> DataFrame:
    decl = facts.syms(spark, d, ("that",)).select(F.lit("decl").alias("how"), "file_id", F.col("start_at").alias("pos"))
    own = facts.files(spark, d).where("lang = 'en' and source = 'workspace'").select("file_id")
    return decl.unionByName(facts.occurrences(spark, d, own, ("that",)).select(F.lit("same_lang").alias("how"), "file_id", "pos"))


UNRESOLVED_SQL = """SELECT o.file_id, o.pos, o.key FROM occ o
LEFT JOIN (SELECT DISTINCT key FROM syms WHERE (flags & 8) <> 0) e ON e.key = o.key
LEFT JOIN (SELECT DISTINCT file_id, key FROM syms) l ON l.file_id = o.file_id AND l.key = o.key
WHERE e.key IS NULL AND l.key IS NULL AND o.key NOT IN ('that', 'with', 'this')"""


def _unresolved(spark: SparkSession, d: str) -> DataFrame:
    calls = facts.occurrences(spark, d)
    s = facts.syms(spark, d)
    builtins = F.broadcast(spark.sql("SELECT * FROM VALUES ('that'), ('with'), ('this') AS t(key)"))
    exported = s.where(F.col("flags").bitwiseAND(8) != 0).select("key").distinct()
    calls = calls.join(exported, "key", "left_anti")
    return U.unresolved_function(calls, builtins, s.select("file_id", "key"), s.select("file_id", "key"))


@register("rule_unresolved_function", f"WITH {SYMS_SQL} SELECT 'unresolved-function' AS rule, 'hint' AS severity, file_id, pos, key AS subject FROM ({UNRESOLVED_SQL})")
def rule_unresolved_function(spark: SparkSession, d: str) -> DataFrame:
    return _unresolved(spark, d)


METHODS = "('R0', 'pay'), ('R1', 'pay'), ('N3', 'ship'), ('N7', 'ship')"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    of = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    return c.select(F.col("c_nationkey").alias("file_id"), F.col("c_custkey").alias("pos"), of.alias("class"), F.when(F.col("c_custkey") % 2 == 0, "pay").otherwise("ship").alias("method"))


@register("rule_unresolved_method", f"WITH {H_SQL}, m(node, method) AS (VALUES {METHODS}), c AS (SELECT c_nationkey AS file_id, c_custkey AS pos, c_nationkey AS n, CASE WHEN c_custkey % 2 = 0 THEN 'pay' ELSE 'ship' END AS method FROM customer) SELECT 'unresolved-method' AS rule, 'hint' AS severity, file_id, pos, c.method AS subject FROM c JOIN nation ON n_nationkey = n WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.method = c.method AND (m.node = 'N' || n OR m.node = 'R' || n_regionkey))")
def rule_unresolved_method(spark: SparkSession, d: str) -> DataFrame:
    """Methods that no ancestor of a closed line has."""
    calls = _calls(spark, d)
    seeds = calls.select(F.col("class").alias("origin"))
    h = hierarchy(spark, d)
    known = h.select(F.col("dst").alias("node")).union(h.select("src")).distinct()
    methods = spark.sql(f"SELECT * FROM VALUES {METHODS} AS t(node, method)")
    return U.unresolved_method(calls, G.closure(h, seeds), methods, G.unresolved(h, seeds, known))


@register("rule_role_requires", f"WITH m(node, method) AS (VALUES {METHODS}) SELECT 'role-requires-unfulfilled' AS rule, 'warning' AS severity, s_nationkey::BIGINT AS file_id, s_suppkey AS pos, 'ship' AS subject FROM supplier WHERE NOT EXISTS (SELECT 1 FROM m WHERE method = 'ship' AND node = 'N' || s_nationkey)")
def rule_role_requires(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("file_id"), F.col("s_suppkey").alias("pos"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("class"), F.lit("ship").alias("method"))
    methods = spark.sql(f"SELECT * FROM VALUES {METHODS} AS t(node, method)")
    return U.unfulfilled_requirement(s, G.closure(hierarchy(spark, d), s.select(F.col("class").alias("origin"))), methods)


NARROW_SQL = "n AS (SELECT user_id AS file_id, event_id AS pos, event_type AS var, CASE CAST(floor(value) AS INT) % 5 WHEN 0 THEN 'Undef' WHEN 1 THEN 'Optional<HashRef>' WHEN 2 THEN 'HashRef' WHEN 3 THEN 'ArrayRef' END AS type FROM events)"


def _narrowed(spark: SparkSession, d: str) -> DataFrame:
    n = F.floor("value").cast("int") % 5
    t = F.when(n == 0, "Undef").when(n == 1, "Optional<HashRef>").when(n == 2, "HashRef").when(n == 3, "ArrayRef")
    return table(spark, d, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("var"), t.alias("type"))


@register("rule_narrowed_deref", f"WITH {NARROW_SQL} SELECT CASE WHEN type = 'Undef' THEN 'undef-deref' ELSE 'optional-deref' END AS rule, CASE WHEN type = 'Undef' THEN 'warning' ELSE 'info' END AS severity, file_id, pos, var AS subject FROM n WHERE type = 'Undef' OR starts_with(type, 'Optional<')")
def rule_narrowed_deref(spark: SparkSession, d: str) -> DataFrame:
    return U.narrowed_deref(_narrowed(spark, d))


@register("rule_shape_mismatch", f"WITH {NARROW_SQL} SELECT 'deref-shape-mismatch' AS rule, 'warning' AS severity, file_id, pos, var AS subject FROM n WHERE type IN ('ArrayRef', 'HashRef') AND type <> CASE WHEN pos % 2 = 0 THEN 'HashRef' ELSE 'ArrayRef' END")
def rule_shape_mismatch(spark: SparkSession, d: str) -> DataFrame:
    n = _narrowed(spark, d).withColumn("proved", F.when(F.col("type").isin("ArrayRef", "HashRef"), F.col("type"))).withColumn("demanded", F.when(F.col("pos") % 2 == 0, "HashRef").otherwise("ArrayRef"))
    return U.shape_mismatch(n)


@register("rule_constant_guard", f"WITH {NARROW_SQL} SELECT CASE WHEN type = 'HashRef' THEN 'redundant-guard' ELSE 'contradictory-guard' END AS rule, CASE WHEN type = 'HashRef' THEN 'hint' ELSE 'warning' END AS severity, file_id, pos, var AS subject FROM n WHERE type IS NOT NULL")
def rule_constant_guard(spark: SparkSession, d: str) -> DataFrame:
    return U.constant_guard(_narrowed(spark, d).withColumn("prior", F.col("type")).withColumn("tested", F.lit("HashRef")))


@register("check", f"WITH {NARROW_SQL}, f AS (SELECT 'warning' AS severity FROM n WHERE type = 'Undef' UNION ALL SELECT 'warning' FROM n WHERE type IS NOT NULL AND type <> 'HashRef') SELECT severity, count(*) AS n FROM f GROUP BY severity")
def check(spark: SparkSession, d: str) -> DataFrame:
    """All rules at a severity or worse, counted."""
    n = _narrowed(spark, d)
    found = U.check([U.narrowed_deref(n), U.constant_guard(n.withColumn("prior", F.col("type")).withColumn("tested", F.lit("HashRef")))], "warning")
    return found.groupBy("severity").agg(F.count("*").alias("n"))


@register("helper_not_loaded", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def helper_not_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Uses whose provider no entry point loads."""
    loaded = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").join(loaded, "o_custkey", "left_anti").select("o_orderkey")


@register("untyped_dispatch", "SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 WHERE c_custkey IS NULL")
def untyped_dispatch(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("typed"))
    return table(spark, d, "orders").join(c, "o_custkey", "left").where("typed is null").select("o_orderkey")


@register("receiver_gate", "SELECT o_orderkey, CASE WHEN c_mktsegment IS NULL THEN 'untyped' WHEN c_mktsegment = 'BUILDING' THEN 'applies' ELSE 'not_applicable' END AS gate FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 1000")
def receiver_gate(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_acctbal > 1000").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    gate = F.when(F.col("c_mktsegment").isNull(), "untyped").when(F.col("c_mktsegment") == "BUILDING", "applies").otherwise("not_applicable")
    return table(spark, d, "orders").join(c, "o_custkey", "left").select("o_orderkey", gate.alias("gate"))


@register("import_classification", f"WITH {FILES_SQL} SELECT file_id, CASE WHEN l.quality = 1 AND f.source = 'workspace' THEN 'exported' WHEN l.quality = 1 THEN 'optional' WHEN l.quality = 0 THEN 'hidden' ELSE 'unknown' END AS verdict FROM files f LEFT JOIN labels l ON l.doc_id = f.file_id")
def import_classification(spark: SparkSession, d: str) -> DataFrame:
    f = facts.files(spark, d).join(table(spark, d, "labels").select(F.col("doc_id").alias("file_id"), "quality"), "file_id", "left")
    v = F.when((F.col("quality") == 1) & (F.col("source") == "workspace"), "exported").when(F.col("quality") == 1, "optional").when(F.col("quality") == 0, "hidden").otherwise("unknown")
    return f.select("file_id", v.alias("verdict"))


@register("dispatch_handlers", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_partkey % 25 = s_nationkey WHERE list_contains(['SMALL', 'ECONOMY'], p_type) AND s_acctbal > 6000")
def dispatch_handlers(spark: SparkSession, d: str) -> DataFrame:
    """Handlers of an owner whose dispatchers include the one used; stacked handlers all come."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 25).cast("int").alias("owner"), F.col("p_type").alias("dispatcher"))
    h = table(spark, d, "supplier").where("s_acctbal > 6000").select("s_suppkey", F.col("s_nationkey").cast("int").alias("owner"), F.array(F.lit("SMALL"), F.lit("ECONOMY")).alias("dispatchers"))
    return p.join(h, "owner").where(F.array_contains("dispatchers", F.col("dispatcher"))).select("p_partkey", "s_suppkey")


@register("class_fields_inherited", "SELECT s_suppkey AS class, 'n' || n_nationkey AS field FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_suppkey, 'r' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def class_fields_inherited(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("origin"))
    up = G.closure(hierarchy(spark, d), seeds)
    return up.select(F.expr("cast(substr(origin, 2) as bigint)").alias("class"), F.lower("node").alias("field"))
