"""The extract stage over source text: each oracle states from the columns what the generated programs hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators import extract as X
from factloom.operators.graph import kept
from factloom.plans.registry import register
from factloom.sources import code

#: Programs that are analysed, and the nations' own.
C = f"c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer WHERE c_custkey % {code.DEEP_EVERY} <> {code.DEEP_REST}), b AS (SELECT n_nationkey AS n, -1 - n_nationkey::BIGINT AS f FROM nation)"

#: All programs, however deeply nested, and the nations' own.
ALL = "c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer), b AS (SELECT n_nationkey AS n, -1 - n_nationkey::BIGINT AS f FROM nation)"


def statements(spark: SparkSession, d: str) -> DataFrame:
    return X.statements(code.programs(spark, d))


def rows(spark: SparkSession, d: str) -> DataFrame:
    return X.scoped(statements(spark, d))


def sql(*parts: str) -> str:
    return f"WITH {C} " + " UNION ALL ".join(parts)


@register("too_deep", f"SELECT c_custkey AS file_id, 'not-analysed' AS rule, 'info' AS severity, {code.NESTING + 1}::BIGINT AS depth FROM customer WHERE c_custkey % {code.DEEP_EVERY} = {code.DEEP_REST}")
def too_deep(spark: SparkSession, d: str) -> DataFrame:
    """Files nested too deeply give a finding instead of facts."""
    return X.too_deep(statements(spark, d)).withColumn("depth", F.col("depth").cast("long"))


#: (line, kind, name, sub) of a customer's program; k and n are columns.
DECLARED = """(0, 'package', 'Shop::C' || k, NULL), (6, 'variable', '@EXPORT_OK', NULL), (7, 'variable', '%EXPORT_TAGS', NULL), (12, 'sub', 'new', 'new'),
(13, 'parameter', '$class', 'new'), (13, 'parameter', '%args', 'new'), (14, 'variable', '$self', 'new'), (17, 'sub', 'run_' || k, 'run_' || k),
(18, 'parameter', '$self', 'run_' || k), (18, 'parameter', '$x', 'run_' || k), (18, 'parameter', '$y', 'run_' || k), (21, 'variable', '$total', 'run_' || k),
(22, 'variable', '$copy', 'run_' || k), (32, 'variable', '$obj', 'run_' || k), (33, 'variable', '$who', 'run_' || k),
(42, 'sub', 'stop_' || n, 'stop_' || n), (42, 'parameter', '$self', 'stop_' || n)"""
DECLARED_SQL = sql(
    f"SELECT k AS file_id, x.* , 'Shop::C' || k AS package FROM c, LATERAL (VALUES {DECLARED}) AS x(line, kind, name, sub)",
    "SELECT f, x.*, 'Shop::N' || n FROM b, LATERAL (VALUES (0, 'package', 'Shop::N' || n, NULL), (2, 'sub', 'base_' || n, 'base_' || n), (3, 'parameter', '$self', 'base_' || n)) AS x(line, kind, name, sub)",
)


@register("extract_declarations", DECLARED_SQL)
def extract_declarations(spark: SparkSession, d: str) -> DataFrame:
    return X.declarations(rows(spark, d))


CALLED = """(23, 'function', NULL, 'load_' || n), (24, 'method', '$self', 'stop_' || n), (31, 'qualified', 'Shop::Util', 'log_' || n), (32, 'method', 'Shop::C' || k, 'new'),
(33, 'method', '$obj', 'owner'), (34, 'method', '$who', 'isa'), (35, 'method', '$who', 'pay'), (38, 'method', '$self', 'on'), (39, 'function', NULL, 'mystery_' || k)"""


@register("extract_calls", sql(f"SELECT k AS file_id, x.*, 'Shop::C' || k AS package, 'run_' || k AS sub FROM c, LATERAL (VALUES {CALLED}) AS x(line, kind, receiver, name)"))
def extract_calls(spark: SparkSession, d: str) -> DataFrame:
    return X.calls(rows(spark, d))


USED = """(3, 'parent', 'Shop::N' || n, NULL), (2, 'root', 'lib/n' || n, NULL), (4, 'import', 'Shop::Util', 'load_' || n), (4, 'import', 'Shop::Util', 'save_' || n), (5, 'constant', 'LIMIT', '' || k),
(6, 'assignment', '@EXPORT_OK', 'qw(run_' || k || ' stop_' || n || ')'), (7, 'assignment', '%EXPORT_TAGS', '(all => [qw(run_' || k || ' stop_' || n || ')], ctl => [qw(stop_' || n || ')])'),
(14, 'assignment', '$self', 'bless { name => $args{name}, rank => ' || n || ' }, $class'), (21, 'assignment', '$total', '$x'), (22, 'assignment', '$copy', '$total'), (28, 'assignment', '$x', '1'),
(32, 'assignment', '$obj', 'Shop::C' || k || '->new'), (33, 'assignment', '$who', '$obj->owner->boss')"""


@register("extract_uses", sql(f"SELECT k AS file_id, x.*, 'Shop::C' || k AS package FROM c, LATERAL (VALUES {USED}) AS x(line, kind, name, value)", "SELECT k, 1, 'import', 'AutoLoader', NULL, 'Shop::C' || k FROM c WHERE k % 3 = 0"))
def extract_uses(spark: SparkSession, d: str) -> DataFrame:
    """Imports, constants, parents, search roots and assignments."""
    return X.uses(rows(spark, d))


ACCESSORS = "(8, 'color_' || n, 'accessor', 'Str'), (9, 'owner', 'getter', 'Shop::N' || n), (9, 'has_owner', 'predicate', NULL)"


@register("synthesized_accessors", sql(f"SELECT k AS file_id, x.*, 'Shop::C' || k AS package FROM c, LATERAL (VALUES {ACCESSORS}) AS x(line, name, role, type)", "SELECT f, 1, 'boss', 'getter', 'Shop::C' || n, 'Shop::N' || n FROM b"))
def synthesized_accessors(spark: SparkSession, d: str) -> DataFrame:
    return X.accessors(rows(spark, d))


@register("export_table", sql("SELECT k AS file_id, 'Shop::C' || k AS package, x.*, false AS always FROM c, LATERAL (VALUES (NULL, 'run_' || k), (NULL, 'stop_' || n), ('all', 'run_' || k), ('all', 'stop_' || n), ('ctl', 'stop_' || n)) AS x(tag, name)"))
def export_table(spark: SparkSession, d: str) -> DataFrame:
    return X.exports(rows(spark, d))


FLOWS = "(21, 'assign', '$x', '$total', 'run_' || k), (22, 'assign', '$total', '$copy', 'run_' || k), (23, 'argument', '$copy', 'load_' || n, 'run_' || k), (24, 'argument', '$total', '$self->stop_' || n, 'run_' || k), (35, 'argument', '$y', '$who->pay', 'run_' || k), (15, 'return', '$self', 'new', 'new')"


@register("value_flow", sql(f"SELECT k AS file_id, x.* FROM c, LATERAL (VALUES {FLOWS}) AS x(line, kind, src, dst, sub)"))
def value_flow(spark: SparkSession, d: str) -> DataFrame:
    return X.flows(rows(spark, d))


NARROWED = "('$y', 'Defined', 26, 41), ('$x', 'HashRef', 27, 27), ('$who', 'Shop::R', 35, 35)"


@register("flow_narrowing", sql(f"SELECT k AS file_id, 'run_' || k AS sub, x.* FROM c, LATERAL (VALUES {NARROWED}) AS x(var, type, from_line, to_line)"))
def flow_narrowing(spark: SparkSession, d: str) -> DataFrame:
    """Regions that guards prove: to the block's end, to the sub's end after an early exit, and never beyond a new binding."""
    return X.narrowings(kept(rows(spark, d)))


WITNESSED = """(19, '&run_' || k, 'Str', 'run_' || k), (20, '&run_' || k, 'Num', 'run_' || k), (25, '&run_' || k, 'ArrayRef', 'run_' || k), (28, '$x', 'Num', 'run_' || k),
(32, '$obj', 'Shop::C' || k, 'run_' || k), (40, '&run_' || k, 'HashRef', 'run_' || k), (14, '$self', 'Shop::C' || k, 'new')"""


@register("expression_witnesses", sql(f"SELECT k AS file_id, x.* FROM c, LATERAL (VALUES {WITNESSED}) AS x(line, attachment, type, sub)"))
def expression_witnesses(spark: SparkSession, d: str) -> DataFrame:
    return X.witnesses(rows(spark, d))


@register("bless_typing", sql("SELECT k AS file_id, 'new' AS sub, 14 AS line, '$self' AS var, 'Shop::C' || k AS class FROM c"))
def bless_typing(spark: SparkSession, d: str) -> DataFrame:
    return X.blessed(rows(spark, d))


@register("arity_returns", sql("SELECT k AS file_id, 'Shop::C' || k AS package, 'run_' || k AS sub, x.* FROM c, LATERAL (VALUES (1, 'Str'), (2, 'Num'), (NULL, 'ArrayRef'), (NULL, 'HashRef')) AS x(arity, type)"))
def arity_returns(spark: SparkSession, d: str) -> DataFrame:
    return X.arity_returns(rows(spark, d))


@register("hash_key_owners", sql("SELECT k AS file_id, 42 AS line, 'Shop::C' || k AS package, 'rank' AS key, 'Shop::C' || k AS owner FROM c", "SELECT f, 4, 'Shop::N' || n, 'size', NULL FROM b"))
def hash_key_owners(spark: SparkSession, d: str) -> DataFrame:
    r = kept(rows(spark, d))
    defined, used = X.self_keys(r)
    return X.key_owners(defined, used, X.inherits(r)).select("file_id", "line", "package", "key", "owner")


@register("pinned_calls", sql("SELECT k AS file_id, x.* FROM c, LATERAL (VALUES (23, 'load_' || n, 'Shop::Util'), (39, 'mystery_' || k, NULL)) AS x(line, name, pinned)"))
def pinned_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls by the order of name lookup: the own package, an import, the language."""
    r = rows(spark, d)
    return X.pinned_calls(X.calls(r), X.declarations(r), X.uses(r))


CHAINS = """(24, '$self->stop_' || n, 'Shop::C' || k, NULL), (32, 'Shop::C' || k || '->new', NULL, 'Shop::C' || k), (33, '$obj->owner->boss', NULL, 'Shop::C' || n), (34, '$who->isa', NULL, NULL), (35, '$who->pay', NULL, NULL), (38, '$self->on', NULL, NULL)"""


@register("chain_typing", sql(f"SELECT k AS file_id, 'run_' || k AS sub, x.line, x.chain, x.type FROM c, LATERAL (VALUES {CHAINS}) AS x(line, chain, root, type)"))
def chain_typing(spark: SparkSession, d: str) -> DataFrame:
    """Types of chains of calls, a step a round; the owner of a customer's program comes through the nation's accessor."""
    r = kept(rows(spark, d))
    return X.chain_types(X.chains(r), X.method_types(r), X.witnesses(r), X.inherits(r)).select("file_id", "sub", "line", "chain", "type")


@register("autoload_subs", sql("SELECT k AS file_id, 45 AS line, 'auto_' || k AS name, 'Shop::C' || k AS package FROM c WHERE k % 3 = 0"))
def autoload_subs(spark: SparkSession, d: str) -> DataFrame:
    return X.autoload_subs(rows(spark, d))


S = "s AS (SELECT s_suppkey::BIGINT AS k, s_nationkey AS n FROM supplier)"
PACKED = """('python', 0, 'import', 'os_' || n), ('python', 1, 'def.class', 'S' || k), ('python', 1, 'base', 'Base' || n), ('python', 2, 'def.sub', 'run_' || k), ('python', 3, 'ref.call', 'helper_' || n),
('cpp', 0, 'import', 'n' || n || '.h'), ('cpp', 1, 'def.namespace', 'shop'), ('cpp', 2, 'def.class', 'S' || k), ('cpp', 2, 'base', 'Base' || n), ('cpp', 3, 'context.access', 'public'), ('cpp', 4, 'def.sub', 'run_' || k),
('cpp', 5, 'context.access', 'private'), ('cpp', 6, 'def.field', 'rank_' || n), ('r', 0, 'import', 'n' || n), ('r', 1, 'def.sub', 'run_' || k), ('r', 2, 'ref.call', 'helper_' || n),
('cmake', 0, 'import', 'N' || n), ('cmake', 1, 'def.target', 's' || k), ('cmake', 2, 'ref.target', 'n' || n)"""


@register("capture_packs", f"WITH {S} SELECT k AS file_id, x.* FROM s, LATERAL (VALUES {PACKED}) AS x(lang, line, capture, name)")
def capture_packs(spark: SparkSession, d: str) -> DataFrame:
    """Units of four languages, each by its own declared patterns."""
    return X.events(X.lines(code.units(spark, d)), F.col("lang"))


@register("assembled_analysis", f"WITH {S}, p AS (SELECT k, x.* FROM s, LATERAL (VALUES {PACKED}) AS x(lang, line, capture, name)) SELECT k AS file_id, count(*) FILTER (capture LIKE 'def.%') AS n_symbols, count(*) FILTER (capture LIKE 'ref.%') AS n_references, count(*) FILTER (capture LIKE 'import%') AS n_imports, list_sort(list(DISTINCT name) FILTER (capture LIKE 'def.%')) AS names FROM p GROUP BY k")
def assembled_analysis(spark: SparkSession, d: str) -> DataFrame:
    """What all packs found of a supplier, as one analysis."""
    return X.assemble([capture_packs(spark, d)])


@register("extract_events", sql("""SELECT k AS file_id, 'Shop::C' || k AS package, x.* FROM c, LATERAL (VALUES ('def.package', 1), ('def.sub', 3), ('def.var', 7), ('ref.method', 7), ('ref.key', 3), ('ref.call', 2)) AS x(capture, n)""", "SELECT k, 'Shop::C' || k, 'import', 1 + (k % 3 = 0)::BIGINT FROM c", "SELECT f, 'Shop::N' || b.n, x.* FROM b, LATERAL (VALUES ('def.package', 1), ('def.sub', 1), ('ref.key', 1)) AS x(capture, n)"))
def extract_events(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of captures by kind, with the scope that was open where they stand."""
    return X.events(X.live(rows(spark, d)), "perl").groupBy("file_id", "package", "capture").agg(F.count("*").alias("n"))
