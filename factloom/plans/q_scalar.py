"""Scalar functions over the tables: names, texts, hashes, arrays, maps, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions import names as N, types as Ty
from factloom.plans.registry import register
from factloom.sources.facts import table

NAME_SQL = "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '$' ELSE '' END || CASE s_suppkey % 3 WHEN 0 THEN 'Foo::Bar::' WHEN 1 THEN 'Baz::' ELSE '' END || 'x' || s_suppkey AS name FROM supplier"


def _names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.concat(F.when(k % 4 == 0, "$").otherwise(""), F.when(k % 3 == 0, "Foo::Bar::").when(k % 3 == 1, "Baz::").otherwise(""), F.lit("x"), k.cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", name.alias("name"))


@register("name_functions", f"""WITH n AS ({NAME_SQL}), b AS (SELECT *, regexp_replace(name, '^[$@%&]', '') AS bare FROM n)
SELECT s_suppkey, regexp_extract(name, '^[$@%&]') AS sigil, bare AS stripped, regexp_extract(name, '^[$@%&]') || regexp_extract(bare, '[^:]*$') AS match_key,
 CASE WHEN contains(name, '::') THEN regexp_replace(bare, '::[^:]*$', '') END AS qualifier, regexp_extract(name, '[^:]*$') AS unqualified,
 regexp_full_match(bare, '[A-Za-z_][A-Za-z0-9_]*(::[A-Za-z_][A-Za-z0-9_]*)*') AS class_name, CASE WHEN contains(name, '::') THEN 'qualified' ELSE 'bare' END AS token FROM b""")
def name_functions(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    return _names(spark, d).select("s_suppkey", N.sigil(n).alias("sigil"), N.strip_sigils(n).alias("stripped"), N.match_key(n).alias("match_key"), N.qualifier(n).alias("qualifier"), N.unqualified(n).alias("unqualified"), N.is_class_name(N.strip_sigils(n)).alias("class_name"), N.method_token(n).alias("token"))


@register("package_agreement", """WITH q AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Foo::Bar' WHEN 1 THEN 'Bar' ELSE 'Foo' END AS q FROM supplier)
SELECT a.s_suppkey AS a, b.s_suppkey AS b, b.q = a.q OR ends_with(a.q, '::' || b.q) OR ends_with(b.q, '::' || a.q) AS agrees FROM q a JOIN q b ON b.s_suppkey = a.s_suppkey + 1
UNION ALL SELECT a.s_suppkey, b.s_suppkey, b.q = a.q OR ends_with(a.q, '::' || b.q) OR ends_with(b.q, '::' || a.q) FROM q a JOIN q b ON b.s_suppkey = a.s_suppkey + 3""")
def package_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's package against those of the next and the third after it."""
    k = F.col("s_suppkey") % 3
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), F.when(k == 0, "Foo::Bar").when(k == 1, "Bar").otherwise("Foo").alias("qa"))
    b = a.select(F.col("a").alias("b"), F.col("qa").alias("qb"))
    pairs = a.withColumn("b", F.explode(F.array(F.col("a") + 1, F.col("a") + 3))).join(b, "b")
    return pairs.select("a", "b", N.package_agrees(True, F.col("qa"), F.col("qb")).alias("agrees"))


@register("word_at_point", """SELECT doc_id, part, regexp_extract(substr(l, 1, (length(l) * part // 8)::INT), '[0-9A-Za-z_]*$') || regexp_extract(substr(l, (length(l) * part // 8 + 1)::INT), '^[0-9A-Za-z_]*') AS word
FROM (SELECT doc_id, regexp_replace(lower(text), '[^a-z\\n ]', '', 'g') AS l FROM documents WHERE text IS NOT NULL), range(9) AS r(part)""")
def word_at_point(spark: SparkSession, d: str) -> DataFrame:
    """The word around every eighth of each text."""
    line = F.regexp_replace(F.lower("text"), "[^a-z\n ]", "")
    parts = table(spark, d, "documents").where("text is not null").select("doc_id", line.alias("l"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("part"))
    return parts.select("doc_id", "part", N.word_at(F.col("l"), F.floor(F.length("l") * F.col("part") / 8).cast("int")).alias("word"))


@register("url_links", "SELECT page_id, list_transform(regexp_extract_all(url || '. see ' || url || ')', 'https?://[^\\s<>\"'']+'), lambda u: regexp_replace(u, '[.,;:)\\]]+$', '')) AS links, regexp_extract(url, '^(https?)://([^/?#]+)', 2) AS host FROM pages")
def url_links(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("url", F.lit(". see "), "url", F.lit(")"))
    return table(spark, d, "pages").select("page_id", N.urls(text).alias("links"), F.regexp_extract("url", "^(https?)://([^/?#]+)", 2).alias("host"))


@register("html_links", "SELECT page_id, len(l) AS n_links, list_distinct(l)[1] IS NOT NULL AS any FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages)")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.size(links).cast("long").alias("n_links"), (F.size(links) > 0).alias("any"))


@register("manifest_requires", "SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"/([A-Za-z]+)\"', 1))) AS module FROM pages")
def manifest_requires(spark: SparkSession, d: str) -> DataFrame:
    """What a manifest asks for: every distinct capture, exploded."""
    return table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)"'), F.lit(1)))).alias("module"))


@register("digest12", "SELECT doc_id, left(sha256(text), 12) AS digest FROM documents")
def digest12(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", N.digest12(F.col("text")).alias("digest"))


@register("surface_fingerprint", "SELECT o_custkey, sha256(string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority)) AS fingerprint FROM orders GROUP BY o_custkey")
def surface_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Order-insensitive: the sorted set is hashed."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.sha2(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), "|"), 256).alias("fingerprint"))


@register("csv_html_escape", "SELECT doc_id, CASE WHEN regexp_matches(t, '[\",\\n\\r]') THEN '\"' || replace(t, '\"', '\"\"') || '\"' ELSE t END AS csv, replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN '\"q\" <b>&' ELSE '' END AS t FROM documents)")
def csv_html_escape(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat("text", F.when(F.col("doc_id") % 3 == 0, '"q" <b>&').otherwise(""))
    return table(spark, d, "documents").select("doc_id", N.csv_escaped(t).alias("csv"), N.html_escaped(t).alias("html"))


@register("apply_edits", "SELECT p_partkey, 'new_' || substr(p_name, 3) || '!' AS text FROM part WHERE length(p_name) >= 4")
def apply_edits(spark: SparkSession, d: str) -> DataFrame:
    """Two edits of one text, applied from its end."""
    edit = lambda at, n, s: F.struct(at.cast("int").alias("start"), F.lit(n).alias("size"), F.lit(s).alias("new"))
    edits = F.array(edit(F.lit(0), 2, "new_"), edit(F.length("p_name"), 0, "!"))
    return table(spark, d, "part").where(F.length("p_name") >= 4).select("p_partkey", N.apply_edits(F.col("p_name"), edits).alias("text"))


@register("affix_rename", "SELECT p_partkey, unnest(['', 'has_', 'clear_']) || p_brand || unnest(['', '', '_all']) AS spelling FROM part")
def affix_rename(spark: SparkSession, d: str) -> DataFrame:
    """One declaration's spellings, each with its own affixes."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("", ""), ("has_", ""), ("clear_", "_all"))])
    p = table(spark, d, "part").withColumn("x", F.explode(pairs))
    return p.select("p_partkey", N.affixed(F.col("x.a"), F.col("p_brand"), F.col("x.b")).alias("spelling"))


@register("fold_interpolation", "SELECT 'get_' || n_name || '_' || r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def fold_interpolation(spark: SparkSession, d: str) -> DataFrame:
    """All values of an interpolated string, from its constants' values."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat(F.lit("get_"), "n_name", F.lit("_"), "r_name").alias("value"))


@register(
    "coordinates",
    """SELECT doc_id, part, octet_length(encode(substr(text, 1, length(text) * part // 8)))::BIGINT AS byte_column, md5(left(text, length(text) * part // 8)) AS cut
FROM documents, range(9) AS r(part) WHERE text IS NOT NULL""",
)
def coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Byte offsets of characters at every eighth of each text, and cuts at character boundaries."""
    at = F.floor(F.length("text") * F.col("part") / 8).cast("int")
    parts = table(spark, d, "documents").where("text is not null").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))))
    return parts.select("doc_id", "part", N.byte_column(F.col("text"), at).cast("long").alias("byte_column"), F.md5(F.left("text", at)).alias("cut"))


@register("relative_paths", "SELECT doc_id, CASE WHEN starts_with(p, 'doc/en/') THEN substr(p, 8) ELSE p END AS rel FROM (SELECT doc_id, 'doc/' || lang || '/' || doc_id AS p FROM documents)")
def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    p = F.concat(F.lit("doc/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", N.relative_path(p, F.lit("doc/en")).alias("rel"))


@register("strip_noncode", "SELECT doc_id, len(l) AS n_lines, list_sum(list_transform(l, lambda x: CASE WHEN position('|' IN x) > 0 THEN position('|' IN x) - 1 ELSE length(x) END))::BIGINT AS code_chars FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def strip_noncode(spark: SparkSession, d: str) -> DataFrame:
    """What follows a comment mark is blanked, with columns kept: the lengths of the lines stay."""
    lines = F.split("text", "\n")
    blank = F.transform(lines, lambda x: F.rpad(F.regexp_replace(x, r"\|.*$", ""), F.length(x), " "))
    code = F.aggregate(F.transform(lines, lambda x: F.length(F.regexp_replace(x, r"\|.*$", ""))), F.lit(0), lambda a, x: a + x)
    return table(spark, d, "documents").select("doc_id", F.size(blank).cast("long").alias("n_lines"), code.cast("long").alias("code_chars"))


@register("word_tokens", "SELECT doc_id, i AS line, regexp_extract_all(l, '[A-Za-z]{5,}') AS words FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE len(regexp_extract_all(l, '[A-Za-z]{5,}')) > 0")
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), F.regexp_extract_all("l", F.lit("[A-Za-z]{5,}"), F.lit(0)).alias("words")).where(F.size("words") > 0)


@register("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_extract_string(props, '$.k') AS INT) % 10 = 9 AS nine FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), (k % 10 == 9).alias("nine"))


@register("json_canonical", "SELECT l_orderkey, l_linenumber, '{\"a\":' || l_partkey || ',\"b\":\"' || l_returnflag || '\"}' AS key FROM lineitem")
def json_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Equality keys: fields in sorted order, no blanks."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_json(F.struct(F.col("l_partkey").alias("a"), F.col("l_returnflag").alias("b"))).alias("key"))


@register("map_last_win", "SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') AS f, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY o_custkey")
def map_last_win(spark: SparkSession, d: str) -> DataFrame:
    """A map by key whose last write wins, read by key; null where the key is missing."""
    last = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max_by("o_orderpriority", "o_orderkey").alias("v"))
    m = last.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "v"))).alias("m"))
    return m.select("o_custkey", F.try_element_at("m", F.lit("F")).alias("f"), F.try_element_at("m", F.lit("O")).alias("o"))


@register("array_functions", "WITH a AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS l FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, l[1] AS first, l[-1] AS last, l[3] AS third, l[-9] AS far, list_sort(list_distinct(l)) AS distinct_sorted, list_filter(l, lambda x, i: i % 2 = 1) AS evens, list_contains(l, 10) AS has FROM a")
def array_functions(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("l"))
    at = lambda i: N.element_at_wrapped(F.col("l"), F.lit(i))
    return a.select("l_orderkey", at(0).alias("first"), at(-1).alias("last"), at(2).alias("third"), at(-9).alias("far"), F.array_sort(F.array_distinct("l")).alias("distinct_sorted"), N.even_positions(F.col("l")).alias("evens"), F.array_contains("l", F.lit(10).cast("long")).alias("has"))


@register("destructuring_pairs", "SELECT conv_id, i::INT AS at, r AS role, t AS text FROM (SELECT conv_id, unnest(range(len(rs))) AS i, unnest(rs) AS r, unnest(ts) AS t FROM (SELECT conv_id, list(role ORDER BY turn) AS rs, list(text ORDER BY turn) AS ts FROM conversations GROUP BY conv_id))")
def destructuring_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Names and values of a list assignment, paired by place."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    pairs = F.arrays_zip(F.col("x.role").alias("role"), F.col("x.text").alias("text"))
    return c.select("conv_id", F.posexplode(pairs).alias("at", "p")).select("conv_id", "at", "p.role", "p.text")


@register("closed_shape_typos", "WITH s AS (SELECT o_custkey, list(DISTINCT o_orderstatus) AS k, count(*) > 12 AS open FROM orders GROUP BY o_custkey) SELECT o_custkey, 'P' AS key FROM s WHERE NOT list_contains(k, 'P') AND NOT open")
def closed_shape_typos(spark: SparkSession, d: str) -> DataFrame:
    """Keys read that a closed record doesn't have."""
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("k"), (F.count("*") > 12).alias("open"))
    return s.where(~F.array_contains("k", "P") & ~F.col("open")).select("o_custkey", F.lit("P").alias("key"))


@register("stash_overlay", "SELECT c_custkey, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN 'order' END), c_mktsegment) AS stash FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment")
def stash_overlay(spark: SparkSession, d: str) -> DataFrame:
    """A right map laid over a left one."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("over", F.lit("order"))
    return table(spark, d, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("over", "c_mktsegment").alias("stash"))


@register("bit_flags", "SELECT l_orderkey, l_linenumber, (l_linenumber & 3) | 4 AS flags, 1 << (l_linenumber % 8) AS shifted, (l_linenumber & 2) <> 0 AS writes FROM lineitem")
def bit_flags(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", n.bitwiseAND(3).bitwiseOR(F.lit(4)).alias("flags"), F.expr("shiftleft(1, l_linenumber % 8)").alias("shifted"), (n.bitwiseAND(2) != 0).alias("writes"))


@register("span_arithmetic", "SELECT o_orderkey, o_orderkey % 13 AS size, o_orderkey % 50 <= 20 AND o_orderkey % 50 + o_orderkey % 13 >= 20 AS holds_20, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 13 ELSE (o_orderkey % 5) * 10000 + o_orderkey % 13 END AS area FROM orders")
def span_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", (k % 13).alias("size"), ((k % 50 <= 20) & (k % 50 + k % 13 >= 20)).alias("holds_20"), F.when(k % 2 == 0, k % 13).otherwise((k % 5) * 10000 + k % 13).alias("area"))


@register("kleene_condition", "SELECT l_orderkey, l_linenumber, (CASE l_linenumber % 3 WHEN 0 THEN true WHEN 1 THEN false END) AND (CASE l_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END) AS both, (CASE l_linenumber % 3 WHEN 0 THEN true WHEN 1 THEN false END) OR (CASE l_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END) AS either, NOT (CASE l_linenumber % 3 WHEN 0 THEN true WHEN 1 THEN false END) AS negated FROM lineitem")
def kleene_condition(spark: SparkSession, d: str) -> DataFrame:
    """Guards under partial knowledge: null is unknown."""
    tri = lambda c: F.when(F.col(c) % 3 == 0, True).when(F.col(c) % 3 == 1, False)
    a, b = tri("l_linenumber"), tri("l_partkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (a & b).alias("both"), (a | b).alias("either"), (~a).alias("negated"))


@register("ratio_guarded", "SELECT l_partkey, round(sum(l_extendedprice) / nullif(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 0), 4) AS ratio FROM lineitem GROUP BY l_partkey")
def ratio_guarded(spark: SparkSession, d: str) -> DataFrame:
    r = F.try_divide(F.sum("l_extendedprice"), F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)))
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(r, 4).alias("ratio"))


@register("signature_format", "SELECT conv_id, 'f(' || coalesce(string_agg(role, ', ' ORDER BY turn), '') || ')' AS signature FROM conversations GROUP BY conv_id")
def signature_format(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("params"))
    return c.select("conv_id", N.signature(F.lit("f"), F.col("params"), F.lit(False)).alias("signature"))


@register("type_display", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Foo' WHEN 1 THEN 'HashRef' WHEN 2 THEN 'Foo or undef' ELSE 'unknown' END AS shown FROM part")
def type_display(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    t = F.when(k == 0, "Class:Foo").when(k == 1, "Hash{a,b}").when(k == 2, "Optional<Class:Foo>")
    return table(spark, d, "part").select("p_partkey", Ty.display(t).alias("shown"))


@register("constraint_inner", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Class:Foo' WHEN 1 THEN 'ArrayRef' WHEN 2 THEN 'Numeric' ELSE 'String' END AS inner_type FROM part")
def constraint_inner(spark: SparkSession, d: str) -> DataFrame:
    """Types of constraint expressions."""
    k = F.col("p_partkey") % 4
    spelt = F.when(k == 0, "InstanceOf['Foo']").when(k == 1, "ArrayRef[Int]").when(k == 2, "Int").otherwise("Str")
    return table(spark, d, "part").select("p_partkey", Ty.constraint(spelt).alias("inner_type"))


@register("optional_inner", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type END AS t, coalesce(CASE WHEN p_size % 2 = 0 THEN p_type END, 'undef') AS shown FROM part")
def optional_inner(spark: SparkSession, d: str) -> DataFrame:
    t = Ty.optional_inner(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Optional<"), "p_type", F.lit(">"))))
    return table(spark, d, "part").select("p_partkey", t.alias("t"), F.coalesce(t, F.lit("undef")).alias("shown"))


@register("suffix_moniker", "SELECT n_nationkey, CASE WHEN count(s_suppkey) = 1 THEN max(s_name) END AS resolved FROM nation LEFT JOIN supplier ON right(s_name, 2) = lpad(CAST(n_nationkey * 3 AS VARCHAR), 2, '0') GROUP BY n_nationkey")
def suffix_moniker(spark: SparkSession, d: str) -> DataFrame:
    """A short name stands for the one full name that ends in it, if it is one."""
    n = table(spark, d, "nation").select("n_nationkey", F.lpad((F.col("n_nationkey") * 3).cast("string"), 2, "0").alias("m"))
    s = table(spark, d, "supplier").select("s_name", F.right("s_name", F.lit(2)).alias("m"))
    return n.join(s, "m", "left").groupBy("n_nationkey").agg(F.when(F.count("s_name") == 1, F.max("s_name")).alias("resolved"))
