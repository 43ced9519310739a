"""Macros over units of C: one for each supplier, with the header of its nation and one that all headers take in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators import macros as M
from factloom.operators.graph import kept
from factloom.plans.registry import register
from factloom.sources.code import filled
from factloom.sources.facts import table

KNOWN = {"SHOP_OFF": False, "SHOP_ON": True}
#: {k}: the supplier; {n}: its nation; {b}: a balance; {gap} and {join}: a blank or a line break, by row; {join} continues a directive.
UNIT = """#include "n{n}.h"
#define LIMIT_{k} BASE_{n}
#define MORE(x, ...) take(x,{join}__VA_ARGS__)
#define PING PONG
#define PONG PING
int early = LATE_{k};
#define LATE_{k} 5
int limit = LIMIT_{k}; // LIMIT_{k}
int both = TWICE(SCALE_{n}(LIMIT_{k}));
int loop = PING + LATE_{k};
#ifdef SHOP_OFF
int off = LATE_{k};
#elif defined(SHOP_ON)
int NAMED(run, {k}) = MORE({b}, (1, {k}), LATE_{k});
#endif
#undef TWICE
char *s = TEXT(a{gap}"{k}"); int left = TWICE({k});
"""
HEADER = """#ifndef N{n}_H
#define N{n}_H
#include "all.h"
#define BASE_{n} ({n} + OFFSET)
#define SCALE_{n}(v) ((v) << {n})
#endif
"""
COMMON = "#define OFFSET 100\n#define TWICE(x) ((x) + (x))\n#define NAMED(a, b) a ## _ ## b\n#define TEXT(x) #x\n"
#: What the templates become.
BECOMES = (
    ("limit = ", "LIMIT_{k}", "LIMIT_{k}", "({n} + 100)"),
    ("both = ", "TWICE", "TWICE(SCALE_{n}(LIMIT_{k}))", "((((({n} + 100)) << {n})) + (((({n} + 100)) << {n})))"),
    ("loop = ", "PING", "PING", "PING"),
    ("PING + ", "LATE_{k}", "LATE_{k}", "5"),
    ("#elif defined(SHOP_ON)\nint ", "NAMED", "NAMED(run, {k})", "run_{k}"),
    ("NAMED(run, {k}) = ", "MORE", "MORE({b}, (1, {k}), LATE_{k})", "take({b}, (1, {k}), 5)"),
    ("char *s = ", "TEXT", 'TEXT(a{gap}"{k}")', '"a \\"{k}\\""'),
)


def units(spark: SparkSession, d: str) -> DataFrame:
    """file_id, path, text: suppliers' units, nations' headers (from -1 down) and the common header (-1000)."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    gap, join = (F.when(k % 2 == 0, " ").otherwise(x) for x in ("\n", "\\\n"))
    text = filled(UNIT, k=k, n=n, gap=gap, join=join, b=F.floor("s_acctbal").cast("long"))
    spread = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").repartition(spark.sparkContext.defaultParallelism, "s_suppkey")  # three numbers a row, before they become a text
    own = spread.select(k.cast("long").alias("file_id"), F.concat(F.lit("src/s"), k.cast("string"), F.lit(".c")).alias("path"), text.alias("text"))
    n = F.col("n_nationkey")
    head = table(spark, d, "nation").select((-1 - n).cast("long").alias("file_id"), F.concat(F.lit("src/n"), n.cast("string"), F.lit(".h")).alias("path"), filled(HEADER, n=n).alias("text"))
    common = table(spark, d, "region").agg(F.lit(-1000).cast("long").alias("file_id"), F.lit("src/all.h").alias("path"), F.lit(COMMON).alias("text"))
    return own.unionByName(head).unionByName(common)


def _sql(text: str) -> str:
    """SQL that fills a template from the columns k, n, b, gap and join."""
    out = "'" + text.replace("'", "''") + "'"
    for name in ("k", "n", "b", "gap", "join"):
        out = f"replace({out}, '{{{name}}}', CAST(u.\"{name}\" AS VARCHAR))"
    return out


_EACH = ", ".join(f"({k}, {_sql(b)}, {_sql(name)}, {_sql(use)}, {_sql(new)})" for k, (b, name, use, new) in enumerate(BECOMES))
_MADE_SQL = f"""u AS (SELECT s_suppkey AS k, s_nationkey AS n, CAST(floor(s_acctbal) AS BIGINT) AS b, CASE WHEN s_suppkey % 2 = 0 THEN ' ' ELSE chr(10) END AS gap, CASE WHEN s_suppkey % 2 = 0 THEN ' ' ELSE chr(92) || chr(10) END AS "join" FROM supplier),
m AS (SELECT u.k, x.*, {_sql(UNIT)} AS text FROM u, LATERAL (VALUES {_EACH}) x(ord, ahead, name, used, made)),
s AS (SELECT k, ord, instr(text, ahead) + length(ahead) - 1 AS start_at, name, length(used) AS n_used, made, text FROM m)"""


@register("macro_splices", f"WITH {_MADE_SQL} SELECT CAST(k AS BIGINT) AS file_id, start_at, start_at + n_used AS end_at, name, made AS new FROM s")
def macro_splices(spark: SparkSession, d: str) -> DataFrame:
    """What takes the place of each use of a macro, over all units."""
    made = M.splices(units(spark, d), KNOWN)
    return made.select("file_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "name", F.col("text").alias("new"))


@register("macro_origins", f"""WITH {_MADE_SQL}, o AS (SELECT *, start_at + coalesce(sum(length(made) - n_used) OVER (PARTITION BY k ORDER BY start_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS out_at FROM s)
SELECT CAST(k AS BIGINT) AS file_id, CAST(out_at AS BIGINT) AS pos, CAST(start_at AS BIGINT) AS original FROM o WHERE ord <> 4 AND ord <> 5
UNION ALL SELECT k, CAST(out_at + length(made) AS BIGINT), start_at + n_used FROM o
UNION ALL SELECT k, CAST(out_at + instr(made, ', (1, ') + 1 AS BIGINT), start_at + instr(substr(text, start_at + 1), ', (1, ') + 1 FROM o WHERE ord = 5""")
def macro_origins(spark: SparkSession, d: str) -> DataFrame:
    """Where replacements begin and end in the new text, and an argument within, led back to the text before."""
    made = kept(M.splices(units(spark, d), KNOWN))
    done = M.applied(units(spark, d).where("file_id >= 0"), made)
    places = F.array(*[F.instr("text", b) for b in ("limit = (", "both = (", "loop = PING", "+ 5;", 'char *s = "')])
    first = F.transform(F.arrays_zip(places.alias("p"), F.array(*map(F.lit, (8, 7, 7, 2, 10))).alias("n")), lambda x: x["p"] + x["n"] - 1)
    ends = F.array(*[F.instr("text", b) for b in ("; // LIMIT", ";\nint loop", " + 5;", ";\n#ifdef", " = take", ";\n#endif", "; int left")])
    points = F.concat(first, F.transform(ends, lambda x: x - 1), F.array(F.instr("text", ", (1, ") + 1))
    return M.origins(done.select("file_id", F.explode(points.cast("array<long>")).alias("pos")), made)
