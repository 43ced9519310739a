"""Queries over the relational store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from factloom.model import EXPORTED, ROLES, SYMBOL_KINDS
from factloom.operators import relational as R
from factloom.plans.registry import register
from factloom.session import shared_folder
from factloom.sources import facts
from factloom.sources.facts import FILES_SQL, REFS_SQL, SYMS_SQL, table


@register("scan_files", f"WITH {FILES_SQL} SELECT file_id, path, source FROM files")
def scan_files(spark: SparkSession, d: str) -> DataFrame:
    return facts.files(spark, d).select("file_id", "path", "source")


@register("point_lookup", f"WITH {FILES_SQL} SELECT file_id, source FROM files WHERE path = 'doc/en/11'")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return facts.files(spark, d).where(F.col("path") == "doc/en/11").select("file_id", "source")


@register("warm_scan_meta", "SELECT doc_id AS file_id, n_chars, octet_length(encode(text)) AS payload_bytes, n_chars > 2000 AS large FROM documents")
def warm_scan_meta(spark: SparkSession, d: str) -> DataFrame:
    """Metadata with the length of the payload instead of the payload."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "n_chars", F.octet_length("text").cast("long").alias("payload_bytes"), (F.col("n_chars") > 2000).alias("large"))


@register("role_mask_filter", f"WITH {FILES_SQL} SELECT file_id, CASE source WHEN 'workspace' THEN 2 ELSE 4 END AS role FROM files WHERE (CASE source WHEN 'workspace' THEN 2 ELSE 4 END & 3) <> 0")
def role_mask_filter(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("source") == "workspace", ROLES["workspace"]).otherwise(ROLES["dependency"])
    return facts.files(spark, d).select("file_id", role.alias("role")).where(F.col("role").bitwiseAND(ROLES["open"] | ROLES["workspace"]) != 0)


@register("flag_filter", f"WITH {SYMS_SQL} SELECT file_id, key, flags FROM syms WHERE (flags & 8) <> 0")
def flag_filter(spark: SparkSession, d: str) -> DataFrame:
    return facts.syms(spark, d).where(F.col("flags").bitwiseAND(EXPORTED) != 0).select("file_id", "key", "flags")


@register("symbol_rows", f"WITH {SYMS_SQL} SELECT file_id, key, kind, CASE kind WHEN 1 THEN 'Sub' WHEN 2 THEN 'Method' WHEN 3 THEN 'Package' ELSE 'Class' END AS kind_name, (flags & 1) <> 0 AS linkage_visible, key ~ '^[A-Za-z_]' AND kind IN (1, 2, 4) AS eligible FROM syms")
def symbol_rows(spark: SparkSession, d: str) -> DataFrame:
    """Kind decoding, linkage visibility and the report's eligibility test."""
    name = F.element_at(F.array(*map(F.lit, SYMBOL_KINDS)), F.col("kind") + 1)
    return facts.syms(spark, d).select("file_id", "key", "kind", name.alias("kind_name"), (F.col("flags").bitwiseAND(1) != 0).alias("linkage_visible"), (F.col("key").rlike("^[A-Za-z_]") & F.col("kind").isin(1, 2, 4)).alias("eligible"))


@register("shred_refs", f"WITH {REFS_SQL} SELECT file_id, count(*) AS n_keys FROM refs GROUP BY file_id")
def shred_refs(spark: SparkSession, d: str) -> DataFrame:
    """References are deduplicated per file, without a shuffle of occurrences by key."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(facts.TOKEN), F.lit(0)))
    return table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.size(tokens).cast("long").alias("n_keys")).where("n_keys > 0")


@register("intern_strings", f"WITH {REFS_SQL} SELECT dense_rank() OVER (ORDER BY key) AS str_id, key AS s FROM (SELECT DISTINCT key FROM refs)")
def intern_strings(spark: SparkSession, d: str) -> DataFrame:
    return R.intern(facts.refs(spark, d), "key")


@register("string_gc", f"WITH {SYMS_SQL} SELECT key AS s FROM (SELECT DISTINCT key FROM refs) r WHERE NOT EXISTS (SELECT 1 FROM syms WHERE syms.key = r.key)")
def string_gc(spark: SparkSession, d: str) -> DataFrame:
    strings = facts.refs(spark, d).select(F.col("key").alias("str_id")).distinct().withColumn("s", F.col("str_id"))
    return R.collect_garbage(strings, facts.syms(spark, d).select("key")).select("s")


@register("source_precedence_upsert", f"WITH {FILES_SQL} SELECT lang, CASE WHEN bool_or(source = 'workspace') THEN 'workspace' ELSE 'import' END AS source FROM files GROUP BY lang")
def source_precedence_upsert(spark: SparkSession, d: str) -> DataFrame:
    return R.upsert_by_precedence(facts.files(spark, d), "lang", "source", ("workspace", "import"))


KEYS = "('tion'), ('that'), ('with'), ('zzzz'), ('aulich')"


def _keys(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {KEYS} AS t(key)")


@register("ref_candidates", f"WITH {REFS_SQL}, k(key) AS (VALUES {KEYS}) SELECT DISTINCT file_id FROM refs WHERE key IN (SELECT key FROM k)")
def ref_candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.candidates(facts.refs(spark, d), F.broadcast(_keys(spark)))


@register("ref_candidates_union", f"WITH {SYMS_SQL}, k(key) AS (VALUES {KEYS}) SELECT file_id FROM refs WHERE key IN (SELECT key FROM k) UNION SELECT file_id FROM syms WHERE key IN (SELECT key FROM k)")
def ref_candidates_union(spark: SparkSession, d: str) -> DataFrame:
    return R.candidates_with_symbols(facts.refs(spark, d), facts.syms(spark, d), F.broadcast(_keys(spark)))


@register("ref_file_counts", f"WITH {REFS_SQL} SELECT key, count(*) AS n_files FROM refs GROUP BY key")
def ref_file_counts(spark: SparkSession, d: str) -> DataFrame:
    """GROUP BY name over all references."""
    return facts.refs(spark, d).groupBy("key").agg(F.count("*").alias("n_files"))


@register("symbol_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('BOLT'))")
def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    """Case-insensitive substring search with a literal needle."""
    return table(spark, d, "part").where(F.contains(F.lower("p_name"), F.lower(F.lit("BOLT")))).select("p_partkey", "p_name")


@register("workspace_symbols", f"WITH {SYMS_SQL} SELECT file_id, key, kind, start_at FROM syms WHERE kind IN (1, 2, 3, 4) AND (flags & 6) = 0 AND contains(key, 'tion')")
def workspace_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Search over visible symbols, one row per identity."""
    s = facts.syms(spark, d).where(F.col("kind").isin(1, 2, 3, 4) & (F.col("flags").bitwiseAND(6) == 0) & F.contains("key", F.lit("tion")))
    return s.select("file_id", "key", "kind", "start_at").dropDuplicates()


@register(
    "exists_three_valued",
    f"WITH {SYMS_SQL}, p AS (SELECT file_id, 'that' AS key FROM files) SELECT p.file_id, p.key, CASE WHEN p.file_id IN (SELECT file_id FROM syms) THEN EXISTS (SELECT 1 FROM syms s WHERE s.file_id = p.file_id AND s.key = p.key) END AS found FROM p",
)
def exists_three_valued(spark: SparkSession, d: str) -> DataFrame:
    """True, false, or null where the file has no symbol rows."""
    s = facts.syms(spark, d).select("file_id", "key")
    return R.exists3(s, facts.files(spark, d).select("file_id", F.lit("that").alias("key")), s, ["file_id", "key"])


@register("has_ref_rows", f"WITH {SYMS_SQL} SELECT file_id FROM files f WHERE EXISTS (SELECT 1 FROM syms s WHERE s.file_id = f.file_id)")
def has_ref_rows(spark: SparkSession, d: str) -> DataFrame:
    return facts.files(spark, d).join(facts.syms(spark, d), "file_id", "left_semi").select("file_id")


@register("unused_exports", f"WITH {SYMS_SQL} SELECT file_id, key FROM syms y WHERE (flags & 8) <> 0 AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.key = y.key AND r.file_id <> y.file_id)")
def unused_exports(spark: SparkSession, d: str) -> DataFrame:
    return R.unused_exports(facts.syms(spark, d), facts.refs(spark, d))


@register("semi_prune", f"WITH {SYMS_SQL} SELECT DISTINCT key FROM syms WHERE key IN (SELECT r.key FROM refs r JOIN files f ON r.file_id = f.file_id WHERE f.source = 'import')")
def semi_prune(spark: SparkSession, d: str) -> DataFrame:
    """Names that any import tier file refers to."""
    imports = facts.files(spark, d).where("source = 'import'").select("file_id")
    return facts.syms(spark, d).select("key").distinct().join(facts.refs(spark, d).join(imports, "file_id", "left_semi"), "key", "left_semi")


@register("decode_left_join", f"WITH {SYMS_SQL} SELECT s.file_id, f.path, s.key, CASE WHEN l.toxic = 1 THEN l.doc_id END AS container_id FROM syms s JOIN files f ON s.file_id = f.file_id LEFT JOIN labels l ON s.file_id = l.doc_id AND l.toxic = 1")
def decode_left_join(spark: SparkSession, d: str) -> DataFrame:
    container = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("file_id"), F.col("doc_id").alias("container_id"))
    return facts.syms(spark, d).join(facts.files(spark, d).select("file_id", "path"), "file_id").join(container, "file_id", "left").select("file_id", "path", "key", "container_id")


@register("two_phase_references", f"WITH {SYMS_SQL}, k AS (SELECT DISTINCT file_id FROM refs WHERE key = 'that') SELECT o.file_id, o.pos, f.source FROM occ o JOIN k ON o.file_id = k.file_id JOIN files f ON o.file_id = f.file_id WHERE o.key = 'that'")
def two_phase_references(spark: SparkSession, d: str) -> DataFrame:
    """Candidate files by the index, the exact matcher on the survivors."""
    key = spark.sql("SELECT 'that' AS key")
    files = R.candidates(facts.refs(spark, d), F.broadcast(key))
    return facts.occurrences(spark, d).where("key = 'that'").join(files, "file_id", "left_semi").join(facts.files(spark, d).select("file_id", "source"), "file_id").select("file_id", "pos", "source")


GEN = "SELECT c_nationkey AS path, o_orderkey AS generation, o_orderstatus AS map FROM orders JOIN customer ON o_custkey = c_custkey"


def _generations(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").alias("path"), F.col("o_orderkey").alias("generation"), F.col("o_orderstatus").alias("map"))


@register("asof_generation", f"SELECT path, max(generation) AS generation, arg_max(map, generation) AS map FROM ({GEN}) WHERE generation <= 5000 GROUP BY path")
def asof_generation(spark: SparkSession, d: str) -> DataFrame:
    return R.as_of(_generations(spark, d), "path", "generation", 5000, ["map"])


@register("prune_generations", f"SELECT path, generation FROM ({GEN}) g WHERE generation >= 5000 OR generation >= (SELECT max(generation) FROM ({GEN}) h WHERE h.path = g.path AND h.generation <= 5000)")
def prune_generations(spark: SparkSession, d: str) -> DataFrame:
    return R.prune(_generations(spark, d), "path", "generation", 5000).select("path", "generation")


@register("repair_frontier", "SELECT c_custkey AS path FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o_custkey = c_custkey AND o_orderkey <= 5000) OR NOT EXISTS (SELECT 1 FROM orders o WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def repair_frontier(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    blobs = table(spark, d, "customer").select(F.col("c_custkey").alias("path"))
    return R.repair_frontier(blobs, o.select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("generation")), o.select(F.col("o_custkey").alias("path"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("version")), 5000, 1)


@register("insert_if_current", "SELECT o_orderkey AS path FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l_orderkey = o_orderkey AND l_linenumber = 1 AND l_returnflag = 'A')")
def insert_if_current(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose stamp still stands in the source table."""
    stubs = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.lit(1).alias("mtime"), F.lit("A").alias("size"))
    sources = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("mtime"), F.col("l_returnflag").alias("size"))
    return R.insert_if_current(stubs, sources).select("path")


@register("invalidate_generation", f"WITH {REFS_SQL} SELECT file_id, count(*) AS n FROM refs WHERE file_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY file_id")
def invalidate_generation(spark: SparkSession, d: str) -> DataFrame:
    """Rows that stay when the files of a key set are dropped."""
    gone = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("file_id"))
    return facts.refs(spark, d).join(gone, "file_id", "left_anti").groupBy("file_id").agg(F.count("*").alias("n"))


@register("store_statistics", f"WITH {SYMS_SQL} SELECT 'files' AS name, count(*) AS n FROM files UNION ALL SELECT 'refs', count(*) FROM refs UNION ALL SELECT 'syms', count(*) FROM syms UNION ALL SELECT 'orphans', count(*) FROM (SELECT DISTINCT key FROM refs) r WHERE NOT EXISTS (SELECT 1 FROM syms WHERE syms.key = r.key)")
def store_statistics(spark: SparkSession, d: str) -> DataFrame:
    r, s = facts.refs(spark, d), facts.syms(spark, d)
    orphans = r.select("key").distinct().join(s.select("key"), "key", "left_anti")
    out = None
    for name, df in (("files", facts.files(spark, d)), ("refs", r), ("syms", s), ("orphans", orphans)):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


@register("reverse_index", f"WITH {SYMS_SQL} SELECT key, list_sort(list(DISTINCT file_id)) AS files, count(DISTINCT kind) AS n_kinds FROM syms WHERE starts_with(key, 'be') GROUP BY key")
def reverse_index(spark: SparkSession, d: str) -> DataFrame:
    """Name to its sorted set of modules."""
    s = facts.syms(spark, d).where(F.col("key").startswith("be"))
    return s.groupBy("key").agg(F.sort_array(F.collect_set("file_id")).alias("files"), F.count_distinct("kind").alias("n_kinds"))


@register("ranked_provider", f"WITH {SYMS_SQL} SELECT key, s.file_id, start_at FROM syms s JOIN files f ON s.file_id = f.file_id QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE f.source WHEN 'workspace' THEN 0 ELSE 1 END, s.file_id) = 1")
def ranked_provider(spark: SparkSession, d: str) -> DataFrame:
    """The name slot's winner by tier, then file."""
    s = facts.syms(spark, d).join(facts.files(spark, d).select("file_id", "source"), "file_id")
    return R.first_per_key(s.select("key", "file_id", "start_at", "source"), ["key"], [F.when(F.col("source") == "workspace", 0).otherwise(1), F.col("file_id")]).select("key", "file_id", "start_at")


@register("provider_after_unregister", f"WITH {SYMS_SQL} SELECT key, s.file_id FROM syms s JOIN files f ON s.file_id = f.file_id WHERE s.file_id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE f.source WHEN 'workspace' THEN 0 ELSE 1 END, s.file_id) = 1")
def provider_after_unregister(spark: SparkSession, d: str) -> DataFrame:
    """The next-ranked survivors once every seventh provider is gone (an anti-join with the list of removals)."""
    gone = facts.files(spark, d).where("file_id % 7 = 0").select("file_id")
    s = facts.syms(spark, d).join(facts.files(spark, d).select("file_id", "source"), "file_id").join(gone, "file_id", "left_anti")
    return R.first_per_key(s.select("key", "file_id", "source"), ["key"], [F.when(F.col("source") == "workspace", 0).otherwise(1), F.col("file_id")]).select("key", "file_id")


@register("tier_union", f"WITH {FILES_SQL}, t AS (SELECT file_id % 400 AS path, 0 AS tier, file_id FROM files WHERE file_id % 5 = 0 UNION ALL SELECT file_id % 400, CASE source WHEN 'workspace' THEN 1 ELSE 2 END, file_id FROM files) SELECT path, tier, file_id FROM t QUALIFY row_number() OVER (PARTITION BY path ORDER BY tier, file_id) = 1")
def tier_union(spark: SparkSession, d: str) -> DataFrame:
    """Open files shadow the workspace, which shadows dependencies."""
    f = facts.files(spark, d)
    opened = f.where("file_id % 5 = 0").select((F.col("file_id") % 400).alias("path"), F.lit(0).alias("tier"), "file_id")
    rest = f.select((F.col("file_id") % 400).alias("path"), F.when(F.col("source") == "workspace", 1).otherwise(2).alias("tier"), "file_id")
    return R.first_per_key(opened.unionByName(rest), ["path"], [F.col("tier"), F.col("file_id")])


@register("set_difference", f"WITH {SYMS_SQL} SELECT DISTINCT key FROM refs EXCEPT SELECT key FROM syms")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return facts.refs(spark, d).select("key").distinct().exceptAll(facts.syms(spark, d).select("key").distinct())


@register("set_intersection", f"WITH {REFS_SQL} SELECT key FROM refs r JOIN documents ON doc_id = file_id WHERE lang = 'en' INTERSECT SELECT key FROM refs r JOIN documents ON doc_id = file_id WHERE lang = 'de'")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    r = facts.refs(spark, d).join(facts.files(spark, d).select("file_id", "lang"), "file_id")
    return r.where("lang = 'en'").select("key").intersect(r.where("lang = 'de'").select("key"))


@register("include_closure_prefix", f"WITH {SYMS_SQL} SELECT s.key, s.file_id FROM syms s WHERE starts_with(s.key, 'the') AND s.file_id IN (SELECT file_id FROM files WHERE lang = 'en' AND source = 'workspace')")
def include_closure_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Definitions with a prefix that are visible through a set of files."""
    visible = facts.files(spark, d).where("lang = 'en' and source = 'workspace'").select("file_id")
    return facts.syms(spark, d).where(F.col("key").startswith("the")).join(visible, "file_id", "left_semi").select("key", "file_id")


@register("import_export_binding", "SELECT c_custkey AS importer, s_suppkey AS exporter, n_name AS name FROM customer JOIN supplier ON c_nationkey = s_nationkey JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 5000 AND s_acctbal > 5000")
def import_export_binding(spark: SparkSession, d: str) -> DataFrame:
    """Importers bound to every exporter of the name they ask for."""
    imports = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("importer"), F.col("c_nationkey").alias("k"))
    exports = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("exporter"), F.col("s_nationkey").alias("k"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return imports.join(exports, "k").join(names, "k").select("importer", "exporter", "name")


@register("find_exporters", f"WITH {SYMS_SQL} SELECT key, list_sort(list(file_id)) AS exporters FROM syms WHERE (flags & 8) <> 0 AND len(key) >= 12 GROUP BY key")
def find_exporters(spark: SparkSession, d: str) -> DataFrame:
    s = facts.syms(spark, d).where((F.col("flags").bitwiseAND(EXPORTED) != 0) & (F.length("key") >= 12))
    return s.groupBy("key").agg(F.sort_array(F.collect_list("file_id")).alias("exporters"))


@register("auto_import_candidates", f"WITH {SYMS_SQL} SELECT DISTINCT key FROM syms WHERE (flags & 8) <> 0 AND key NOT IN (SELECT key FROM refs WHERE file_id = 1)")
def auto_import_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Exported names that one file does not use yet."""
    mine = facts.refs(spark, d).where("file_id = 1").select("key")
    return facts.syms(spark, d).where(F.col("flags").bitwiseAND(EXPORTED) != 0).select("key").distinct().join(mine, "key", "left_anti")


@register("every_nth_sample", f"WITH {FILES_SQL} SELECT file_id, path FROM (SELECT *, row_number() OVER (ORDER BY file_id) AS rn FROM files) WHERE rn % 10 = 0")
def every_nth_sample(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth file in id order; ranks come from ranges, not from one global window."""
    ids = R.intern(facts.files(spark, d).select(F.format_string("%020d", "file_id").alias("k")), "k")
    return facts.files(spark, d).withColumn("k", F.format_string("%020d", "file_id")).join(ids.where("str_id % 10 = 0"), F.col("k") == F.col("s")).select("file_id", "path")


@register("lag_fingerprint_order", "SELECT event_id, user_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def lag_fingerprint_order(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", "user_id", F.lag("value").over(w).alias("previous"))


@register("inverted_index_lookup", f"WITH {REFS_SQL} SELECT key, file_id FROM refs WHERE key IN ('that', 'aulich', 'thonre')")
def inverted_index_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The index by name, written once and read by key: the folders of other keys are pruned."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    R.index_by_name(facts.refs(spark, d), path)
    return R.lookup(spark, path, ("that", "aulich", "thonre"))
