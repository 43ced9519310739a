"""The usage heatmap and its sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions import names as N
from factloom.model import EXPORTED

#: Callable kinds (Sub, Method), implicitly used kinds (Package, Class, Module), entry points.
CALLABLE, IMPLICIT, ENTRY_POINTS = (1, 2), (3, 4, 5), ("main",)


def guard(fan_in: Column, exported: Column, name: Column, kind: Column, native: Column, dynamic: Column) -> Column:
    """Why a symbol without uses isn't dead, the most specific reason first; null where it has uses or no excuse."""
    return (
        F.when(fan_in > 0, F.lit(None).cast("string"))
        .when(exported, "exported")
        .when(N.is_constructor(name), "constructor")
        .when(~native, "framework-synthesized")
        .when(kind.isin(*CALLABLE) & name.isin(*ENTRY_POINTS), "entry-point")
        .when(kind.isin(*IMPLICIT), "package-implicit-use")
        .when(dynamic & kind.isin(*CALLABLE), "dynamic-dispatch")
    )


def heatmap(syms: DataFrame, uses: DataFrame, bodies: DataFrame | None = None, dynamic: Column | None = None) -> DataFrame:
    """One row per symbol (file_id, key, kind, start_at, flags) with its uses counted over uses (file_id, key, n).

    Uses are summed per key before they meet the symbols, and a file's own share is looked up beside; so a popular name is
    one row, and no list of its sites is ever built. bodies (file_id, key, callee) gives the fan-out.
    """
    totals = uses.groupBy("key").agg(F.sum("n").alias("all_uses"))
    own = uses.groupBy("file_id", "key").agg(F.sum("n").alias("own_uses"))
    out = syms.join(totals, "key", "left").join(own, ["file_id", "key"], "left")
    exported = F.col("flags").bitwiseAND(EXPORTED) != 0
    fan_in, cross = F.coalesce("all_uses", F.lit(0)), F.coalesce("all_uses", F.lit(0)) - F.coalesce("own_uses", F.lit(0))
    out = out.select("file_id", "key", "kind", "start_at", fan_in.alias("fan_in"), cross.alias("cross_file_fan_in"), exported.alias("exported"))
    if bodies is not None:
        outs = bodies.where("callee <> key").groupBy("file_id", "key").agg(F.count_distinct("callee").alias("fan_out"))
        out = out.join(outs, ["file_id", "key"], "left").withColumn("fan_out", F.when(F.col("kind").isin(*CALLABLE), F.coalesce("fan_out", F.lit(0))))
    return _judged(out, dynamic)


def _judged(out: DataFrame, dynamic: Column | None) -> DataFrame:
    why = guard(F.col("fan_in"), F.col("exported"), F.col("key"), F.col("kind"), F.lit(True), F.lit(False) if dynamic is None else dynamic)
    out = out.withColumn("reachable_guard", why)
    return out.withColumn("dead_code_candidate", (F.col("fan_in") == 0) & F.col("reachable_guard").isNull()).withColumn("dead_export", F.col("kind").isin(*CALLABLE) & F.col("exported") & (F.col("cross_file_fan_in") == 0))


def heatmap_of_sites(sites: DataFrame, dynamic: Column | None = None) -> DataFrame:
    """The heatmap of one relation that holds uses and symbols: file_id, key, n (uses of the key in the file), and kind, start_at, flags where the file declares it.

    Symbols carry their file's own uses already, so that only the totals of keys are joined.
    """
    totals = sites.groupBy("key").agg(F.sum("n").alias("fan_in"))
    out = sites.where("kind is not null").join(totals, "key")
    exported = F.col("flags").bitwiseAND(EXPORTED) != 0
    out = out.select("file_id", "key", "kind", "start_at", "fan_in", (F.col("fan_in") - F.col("n")).alias("cross_file_fan_in"), exported.alias("exported"))
    return _judged(out, dynamic)


def write_report(rows: DataFrame, path: str, kind: str) -> None:
    """Sort by use and write as json, csv (RFC 4180 quotes) or one html table per part."""
    rows = rows.orderBy(F.desc("fan_in"), "file_id", "start_at", "key")
    if kind == "json":
        rows.write.mode("overwrite").json(path)
    elif kind == "csv":
        rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif kind == "html":
        cells = [F.concat(F.lit("<td>"), N.html_escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in rows.columns]
        rows.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"no such report: {kind}")
