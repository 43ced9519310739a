"""Questions over extracted programs, and functions of types, reports and stores; oracles state the answers from the columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions import types as T
from factloom.operators import extract as X, navigate as N, rules as U, store as ST
from factloom.operators.graph import dealt, kept
from factloom.plans.q_extract import ALL, C, S, rows, sql, statements
from factloom.plans.registry import register
from factloom.session import shared_folder
from factloom.sources import code
from factloom.sources.facts import table

#: (line, var, type) of a customer's program; the owner's boss comes through the nation's accessor.
TYPED = """(13, '$class', 'Shop::C' || k), (14, '$class', 'Shop::C' || k), (14, '$self', 'Shop::C' || k), (15, '$self', 'Shop::C' || k), (18, '$self', 'Shop::C' || k), (24, '$self', 'Shop::C' || k),
(37, '$self', 'Shop::C' || k), (38, '$self', 'Shop::C' || k), (42, '$self', 'Shop::C' || k), (32, '$obj', 'Shop::C' || k), (33, '$obj', 'Shop::C' || k), (33, '$who', 'Shop::C' || n), (34, '$who', 'Shop::C' || n),
(35, '$who', 'Shop::R'), (27, '$x', 'HashRef'), (28, '$x', 'Num'), (29, '$x', 'Num'), (35, '$y', 'Defined')"""
TYPE_AT = f"t AS (SELECT k AS file_id, x.* FROM c, LATERAL (VALUES {TYPED}) AS x(line, var, type) UNION ALL SELECT f, x.* FROM b, LATERAL (VALUES (3, '$self', 'Shop::N' || n), (4, '$self', 'Shop::N' || n)) AS x(line, var, type))"


@register("type_at", f"WITH {ALL}, {TYPE_AT} SELECT * FROM t")
def type_at(spark: SparkSession, d: str) -> DataFrame:
    """The type of every mention of a variable in every program, however deeply nested: narrowed, else last witnessed, else the invocant's."""
    return N.type_at(kept(statements(spark, d))).select("file_id", "line", "var", "type")


@register("type_definition", f"WITH {C}, {TYPE_AT}, p AS (SELECT 'Shop::C' || k AS class, k AS def_file FROM c UNION ALL SELECT 'Shop::N' || n, f FROM b) SELECT file_id, line, var, class, def_file, 0 AS def_line FROM t JOIN p ON type = class")
def type_definition(spark: SparkSession, d: str) -> DataFrame:
    return N.type_definitions(kept(rows(spark, d)))


STAMPED = "(24, '$self', 'stop_' || n, 'Shop::C' || k, k, 42), (32, 'Shop::C' || k, 'new', 'Shop::C' || k, k, 12), (33, '$obj', 'owner', 'Shop::C' || k, k, 9), (34, '$who', 'isa', 'Shop::C' || n, NULL, NULL), (35, '$who', 'pay', 'Shop::R', NULL, NULL), (38, '$self', 'on', 'Shop::C' || k, NULL, NULL)"


@register("stamped_calls", f"WITH {ALL} SELECT k AS file_id, x.* FROM c, LATERAL (VALUES {STAMPED}) AS x(line, receiver, name, class, def_file, def_line)")
def stamped_calls(spark: SparkSession, d: str) -> DataFrame:
    """Every method call of every program, however deeply nested, with the class it is sent to and the place that answers."""
    return N.stamped_calls(kept(statements(spark, d)))


@register("binding_edges", sql("SELECT k AS file_id, 'run_' || k AS sub, x.* FROM c, LATERAL (VALUES (32, '$obj', 'Shop::C' || k, 'new'), (33, '$who', 'Shop::N' || n, 'boss')) AS x(line, var, class, method)"))
def binding_edges(spark: SparkSession, d: str) -> DataFrame:
    return N.binding_edges(kept(rows(spark, d)))


@register("signature_help", sql("SELECT k AS file_id, x.* FROM c, LATERAL (VALUES (24, 'stop_' || n, 'stop_' || n || '()', 0), (32, 'new', 'new(%args)', 0)) AS x(line, name, label, slot)"))
def signature_help(spark: SparkSession, d: str) -> DataFrame:
    return N.signatures(rows(spark, d))


@register("leading_docs", sql("SELECT k AS file_id, 'new' AS sub, 'Makes one.' || chr(10) || 'It has a rank of ' || n || '.' AS doc FROM c"))
def leading_docs(spark: SparkSession, d: str) -> DataFrame:
    return N.leading_docs(rows(spark, d))


@register("folding_ranges", sql("SELECT k AS file_id, x.* FROM c, LATERAL (VALUES (12, 16), (17, 41), (26, 30), (34, 36)) AS x(start_line, end_line)", "SELECT f, 2, 5 FROM b"))
def folding_ranges(spark: SparkSession, d: str) -> DataFrame:
    return N.folding_ranges(rows(spark, d))


@register("linked_editing", sql("SELECT k AS file_id, 'run_' || k AS sub, x.* FROM c, LATERAL (VALUES (21, 7), (22, 15), (24, 17 + length('' || n)), (40, 22)) AS x(line, col)"))
def linked_editing(spark: SparkSession, d: str) -> DataFrame:
    """The places of one variable that are edited together."""
    return N.linked_ranges(rows(spark, d), "$total").withColumn("col", F.col("col").cast("int"))


@register("hash_key_completion", sql("SELECT 'Shop::C' || k AS package, unnest(['name', 'rank', 'seen_' || n]) AS key FROM c"))
def hash_key_completion(spark: SparkSession, d: str) -> DataFrame:
    return N.own_keys(rows(spark, d))


@register("string_dispatch", sql("SELECT 'Shop::C' || k AS package, 'on' AS dispatcher, 'event_' || n AS event FROM c"))
def string_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return N.handlers(rows(spark, d))


PREFIXES = ["use Shop::U", "    $self->{na", "    $self->na", "    my $na", "    print \"a na", "    lo", "    f(", "    @li"]
KINDS = ["module", "hash_key", "method", "variable", "string", "name", "none", "variable"]


@register("cursor_context", f"SELECT p_partkey, ({KINDS})[p_partkey % {len(KINDS)} + 1] AS context FROM part")
def cursor_context(spark: SparkSession, d: str) -> DataFrame:
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), (F.col("p_partkey") % len(PREFIXES) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", N.cursor_context(prefix).alias("context"))


@register("access_gate", f"WITH {S} SELECT k AS file_id, x.* FROM s, LATERAL (VALUES ('run_' || k, 'public', true), ('rank_' || n, 'private', false)) AS x(name, access, visible)")
def access_gate(spark: SparkSession, d: str) -> DataFrame:
    """Members of classes with the access they stand under."""
    return N.member_access(X.events(X.lines(code.units(spark, d).where("lang = 'cpp'")), "cpp"))


@register("include_navigation", "SELECT 'n' || s_nationkey || '.h' AS header, count(*) AS n_includers, min(s_suppkey)::BIGINT AS first FROM supplier GROUP BY s_nationkey")
def include_navigation(spark: SparkSession, d: str) -> DataFrame:
    return N.includers(X.events(X.lines(code.units(spark, d).where("lang = 'cpp'")), "cpp"))


@register("path_keys", f"WITH {C}, v AS (SELECT k AS file_id, unnest(['Shop::C' || k, 'Shop::C' || k || '::new', 'Shop::C' || k || '::run_' || k, 'Shop::C' || k || '::stop_' || n, 'Shop::C' || k || '::@EXPORT_OK', 'Shop::C' || k || '::%EXPORT_TAGS']) AS path FROM c UNION ALL SELECT f, unnest(['Shop::N' || n, 'Shop::N' || n || '::base_' || n]) FROM b) SELECT * FROM v")
def path_keys(spark: SparkSession, d: str) -> DataFrame:
    """Packages, subs and package variables by their path."""
    declared = X.declarations(rows(spark, d)).where("kind in ('package', 'sub') or kind = 'variable' and sub is null")
    return N.path_keys(declared)


SPELT = "'Map< ' || p_brand || ' , List<' || p_type || ',  T> >'"


@register("template_spelling", f"SELECT p_partkey, 'Map<' || p_brand || ',List<' || p_type || ',T>>' AS canonical, 'Map' AS base, [p_brand, 'List<' || p_type || ',T>'] AS arguments, 'Map<' || p_brand || ',List<' || p_type || ',' || p_brand || '>>' AS substituted FROM part")
def template_spelling(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of templates: canonical, taken apart, and with a parameter replaced."""
    spelt = F.concat(F.lit("Map< "), "p_brand", F.lit(" , List<"), "p_type", F.lit(",  T> >"))
    of = F.create_map(F.lit("T"), F.col("p_brand"), F.lit("Map"), F.lit("Map"))
    return table(spark, d, "part").select("p_partkey", T.canonical(spelt).alias("canonical"), T.template_base(spelt).alias("base"), T.template_arguments(spelt).alias("arguments"), T.substituted(spelt, of).alias("substituted"))


@register("search_path", f"WITH {C} SELECT k AS file_id, 'lib/n' || n AS root, 0 AS ord FROM c UNION ALL SELECT k, unnest(['lib', 'local/lib/perl5']), unnest([1, 2]) FROM c")
def search_path(spark: SparkSession, d: str) -> DataFrame:
    """The search roots of each file: its own, then the project's, in order."""
    return ST.search_roots(X.uses(rows(spark, d)).where("kind = 'root'").select("file_id", "line", F.col("name").alias("root")))


@register("verdict_first", "WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.08 THEN 'REGRESSED' WHEN l_discount < 0.02 THEN 'improved' ELSE 'ok' END AS verdict, l_quantity - 25 AS delta, l_quantity AS base FROM lineitem) SELECT l_orderkey, l_linenumber, verdict FROM v ORDER BY (verdict = 'REGRESSED') DESC, abs(delta) / nullif(base, 0) DESC, l_orderkey, l_linenumber LIMIT 50")
def verdict_first(spark: SparkSession, d: str) -> DataFrame:
    """What got worse comes first, then by relative size; a report of the first fifty."""
    verdict = F.when(F.col("l_discount") > 0.08, "REGRESSED").when(F.col("l_discount") < 0.02, "improved").otherwise("ok")
    v = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", verdict.alias("verdict"), (F.col("l_quantity") - 25).alias("delta"), F.col("l_quantity").alias("base"))
    return ST.verdict_first(v, ["l_orderkey", "l_linenumber"], 50).select("l_orderkey", "l_linenumber", "verdict")


@register("unit_conversion", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ms' WHEN 1 THEN 'MB' ELSE 'count' END AS unit, CASE event_id % 3 WHEN 0 THEN value / 1000000.0 WHEN 1 THEN value / 1024.0 ELSE value END AS value FROM events")
def unit_conversion(spark: SparkSession, d: str) -> DataFrame:
    """Measurements in the units of the reports: ns as ms, KB as MB."""
    unit = F.when(F.col("event_id") % 3 == 0, "ns").when(F.col("event_id") % 3 == 1, "KB").otherwise("count")
    return ST.settled(table(spark, d, "events").select("event_id", unit.alias("unit"), "value"))


@register("shape_folding", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE 'f' || p_size END AS uri, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_size END AS line, p_partkey % 3 = 2 AS empty FROM part")
def shape_folding(spark: SparkSession, d: str) -> DataFrame:
    """Answers of three JSON shapes (a location, a list of links, null) folded into one, and whether they are empty."""
    k, s = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    place = F.concat(F.lit('{"uri": "f'), s, F.lit('", "range": {"start": {"line": '), s, F.lit(', "character": 0}}}'))
    link = F.concat(F.lit('[{"targetUri": "f'), s, F.lit('", "targetRange": {"start": {"line": '), s, F.lit(', "character": 0}}}]'))
    answers = table(spark, d, "part").select("p_partkey", F.when(k == 0, place).when(k == 1, link).otherwise("null").alias("answer"))
    return ST.folded(answers)


@register("guard_message", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '$' || p_type || ' is always ' || p_brand || ' here: the guard is redundant' WHEN 1 THEN '$' || p_type || ' is never ' || p_brand || ' here: the guard contradicts what is known' ELSE NULL END AS message FROM part")
def guard_message(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("p_partkey") % 3 == 0, "redundant-guard").when(F.col("p_partkey") % 3 == 1, "contradictory-guard")
    return table(spark, d, "part").select("p_partkey", ST.guard_message(verdict, F.concat(F.lit("$"), "p_type"), F.col("p_brand")).alias("message"))


@register("served_by_both", "WITH a AS (SELECT c_mktsegment AS verb, c_custkey AS id FROM customer WHERE c_mktsegment <> 'BUILDING'), b AS (SELECT c_mktsegment AS verb, c_custkey AS id FROM customer WHERE c_mktsegment <> 'FURNITURE' AND c_custkey % 3 <> 0) SELECT verb, 'left' AS side, count(*) AS n FROM a WHERE verb <> 'FURNITURE' AND id % 3 = 0 GROUP BY verb")
def served_by_both(spark: SparkSession, d: str) -> DataFrame:
    """Answers that only one side has, among the verbs that both serve."""
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("verb"), F.col("c_custkey").alias("id"))
    found = ST.differences(c.where("verb <> 'BUILDING'"), c.where("verb <> 'FURNITURE' and id % 3 <> 0"), "verb")
    return found.groupBy("verb", "side").agg(F.count("*").alias("n"))


@register("generation_publish", "SELECT c_custkey, c_nationkey + 1 AS value, 2 AS generation FROM customer")
def generation_publish(spark: SparkSession, d: str) -> DataFrame:
    """Two generations are written, the second is published, and a third is left unpublished: readers see the second whole."""
    path = f"{shared_folder(spark)}/generations-{uuid.uuid4().hex}"
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("value"))
    ST.publish(c, path, 1)
    ST.publish(c.withColumn("value", F.col("value") + 1), path, 2)
    ST.write_generation(c.limit(3), path, 3)
    return ST.published(spark, path)


@register("store_validators", "SELECT unnest(['conclusions', 'roots']) AS name, unnest([true, false]) AS wiped, unnest([0, (SELECT count(*) FROM nation)]) AS n")
def store_validators(spark: SparkSession, d: str) -> DataFrame:
    """A derived table whose fingerprint differs from the stored one is cleared whole; the other stays."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    kept = {"conclusions": (n, "a"), "roots": (n, "b")}
    return ST.validated(kept, {"conclusions": "a2", "roots": "b"})


@register("rederive", "SELECT event_id AS seq, CASE WHEN event_id < 1000 THEN value ELSE value * 2 END AS value FROM events")
def rederive(spark: SparkSession, d: str) -> DataFrame:
    """Rows behind the baseline are cut off and made anew."""
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), "value")
    return ST.rederived(e.withColumn("value", F.col("value") + 7).where("seq >= 1000").unionByName(e.where("seq < 1000")), "seq", 1000, e.where("seq >= 1000").withColumn("value", F.col("value") * 2))


@register("instrumentation", "SELECT o_orderpriority AS name, count(*) AS n, sum(o_custkey)::BIGINT AS total FROM orders GROUP BY ALL")
def instrumentation(spark: SparkSession, d: str) -> DataFrame:
    """Counters by name, written as JSON lines and read back."""
    path = f"{shared_folder(spark)}/counters-{uuid.uuid4().hex}"
    ST.write_counters(table(spark, d, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("value")), path)
    return spark.read.schema("name string, n long, total long").json(path)


@register("resolve_queue", "WITH q AS (SELECT o_custkey AS name, min(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) AS lane, min(o_orderkey) AS first FROM orders GROUP BY o_custkey) SELECT name, lane, row_number() OVER (ORDER BY lane, first, name) AS place FROM q QUALIFY place <= 100")
def resolve_queue(spark: SparkSession, d: str) -> DataFrame:
    """The next hundred names to resolve: asked for first, then pending, each once, in order of arrival."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("lane"), F.col("o_orderkey").alias("arrival"))
    return ST.next_to_resolve(o, 100)


@register("bounded_wait", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'complete' WHEN p_size % 4 = 1 THEN 'wait' ELSE 'partial' END AS answer FROM part")
def bounded_wait(spark: SparkSession, d: str) -> DataFrame:
    """Whether a question is answered now, waits, or is answered with what there is."""
    s = F.col("p_size") % 4
    return table(spark, d, "part").select("p_partkey", ST.readiness(s == 0, F.when(s == 1, "complete").otherwise("interactive"), F.lit(100), F.lit(500)).alias("answer"))


CHECKED = "(39, 'unresolved-function', 'hint', 'mystery_' || k), (38, 'unresolved-method', 'hint', 'on')"


@register("check_source", sql(f"SELECT k AS file_id, x.* FROM c, LATERAL (VALUES {CHECKED}) AS x(pos, rule, severity, subject)", f"SELECT c_custkey, 0, 'not-analysed', 'info', '{code.NESTING + 1}' FROM customer WHERE c_custkey % {code.DEEP_EVERY} = {code.DEEP_REST}"))
def check_source(spark: SparkSession, d: str) -> DataFrame:
    """Findings over extracted programs: calls that nothing answers, methods that a known class lacks, files not analysed."""
    every = kept(X.statements(code.programs(spark, d)))
    r = X.scoped(every)
    calls = X.pinned_calls(X.calls(r), X.declarations(r), X.uses(r)).where("pinned is null")
    sends = N.stamped_calls(r).join(dealt(N.packages(r).select("class")), "class", "left_semi").where("def_file is null and name not in ('isa', 'can', 'new', 'DOES')")
    found = [
        U.finding(calls.withColumnRenamed("line", "pos"), "unresolved-function", "hint", "name"),
        U.finding(sends.withColumnRenamed("line", "pos"), "unresolved-method", "hint", "name"),
        U.finding(X.too_deep(every).withColumn("pos", F.lit(0)), "not-analysed", "info", F.col("depth").cast("string")),
    ]
    return U.check(found).withColumn("pos", F.col("pos").cast("int"))
