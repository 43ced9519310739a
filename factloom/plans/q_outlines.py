"""Nested outlines and selection ranges of the extracted programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators import outlines as O
from factloom.operators.graph import kept
from factloom.plans.q_extract import rows, sql
from factloom.plans.registry import register

#: (line, kind, name, end_line, level, path below the package) of a customer's program.
NESTED = """(0, 'package', 'Shop::C' || k, 0, 0, ''), (6, 'variable', '@EXPORT_OK', 6, 1, '/@EXPORT_OK'), (7, 'variable', '%EXPORT_TAGS', 7, 1, '/%EXPORT_TAGS'), (12, 'sub', 'new', 16, 1, '/new'), (13, 'variable', '$class', 13, 2, '/new/$class'),
(13, 'variable', '%args', 13, 2, '/new/%args'), (14, 'variable', '$self', 14, 2, '/new/$self'), (17, 'sub', 'run_' || k, 41, 1, '/run_' || k), (18, 'variable', '$self', 18, 2, '/run_' || k || '/$self'), (18, 'variable', '$x', 18, 2, '/run_' || k || '/$x'),
(18, 'variable', '$y', 18, 2, '/run_' || k || '/$y'), (21, 'variable', '$total', 21, 2, '/run_' || k || '/$total'), (22, 'variable', '$copy', 22, 2, '/run_' || k || '/$copy'), (32, 'variable', '$obj', 32, 2, '/run_' || k || '/$obj'),
(33, 'variable', '$who', 33, 2, '/run_' || k || '/$who'), (42, 'sub', 'stop_' || n, 42, 1, '/stop_' || n), (42, 'variable', '$self', 42, 2, '/stop_' || n || '/$self')"""
BASES = "(0, 'package', 'Shop::N' || n, 0, 0, ''), (2, 'sub', 'base_' || n, 5, 1, '/base_' || n), (3, 'variable', '$self', 3, 2, '/base_' || n || '/$self')"
_COLUMNS = "x.line, x.kind, x.name, x.end_line, x.level"


@register("nested_outline", sql(f"SELECT k AS file_id, {_COLUMNS}, 'Shop::C' || k || x.path AS path FROM c, LATERAL (VALUES {NESTED}) AS x(line, kind, name, end_line, level, path)", f"SELECT f, {_COLUMNS}, 'Shop::N' || n || x.path FROM b, LATERAL (VALUES {BASES}) AS x(line, kind, name, end_line, level, path)"))
def nested_outline(spark: SparkSession, d: str) -> DataFrame:
    """Packages, subs and variables of every program, each with its level and the path of names above it."""
    return O.outline(kept(rows(spark, d))).select("file_id", "line", "kind", "name", "end_line", "level", F.array_join("path", "/").alias("path"))


RANGES = "(13, 0, 13, 13), (13, 1, 12, 16), (28, 0, 28, 28), (28, 1, 26, 30), (28, 2, 17, 41), (35, 0, 35, 35), (35, 1, 34, 36), (35, 2, 17, 41), (43, 0, 43, 43)"


@register("selection_ranges", sql(f"SELECT k AS file_id, x.* FROM c, LATERAL (VALUES {RANGES}) AS x(line, level, start_line, end_line)"))
def selection_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The statement at each of four lines of every program, and the blocks around it."""
    r = kept(rows(spark, d))
    points = r.where("file_id >= 0").select("file_id").distinct().select("file_id", F.explode(F.array(*map(F.lit, (13, 28, 35, 43)))).alias("line"))
    return O.selection_ranges(r, points)

