"""Plugins that come with the engine, and the harness that tests a plugin on snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.functions.extension import Pattern, Plugin, emit

EVENTS = Plugin("events", (
    Pattern("handler", r"->on\('(\w+)'", "Handler", {"$x->on('saved');": 1, "$x->once('saved');": 0}),
    Pattern("dispatch", r"->emit\('(\w+)'", "DispatchCall", {"$x->emit('saved', 1);": 1}),
))
ACCESSORS = Plugin("accessors", (Pattern("has", r"^has\s+'?(\w+)'?\s*=>", "Method", {"has owner => (is => 'ro');": 1, "$has{owner} => 1": 0}),))
PARENTS = Plugin("parents", (Pattern("parent", r"^use parent\b.*'([\w:]+)'", "PackageParent", {"use parent -norequire, 'A::B';": 1}),), uses="use parent")
BUNDLED = (EVENTS, ACCESSORS, PARENTS)


def run_all(files: DataFrame, plugins: tuple[Plugin, ...] = BUNDLED) -> DataFrame:
    """plugin, file_id, pattern, kind, name of what all plugins emit."""
    out = None
    for p in plugins:
        rows = emit(files, p).select(F.lit(p.name).alias("plugin"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def harness(spark: SparkSession, plugin: Plugin, cases: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """text, missing, extra: what a plugin emits for each text against the (kind, name) pairs that are expected, in order of text."""
    texts = list(cases)
    files = spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")
    wanted = [(i, k, n) for i, t in enumerate(texts) for k, n in cases[t]]
    expected = spark.createDataFrame(wanted, "file_id long, kind string, name string").distinct()
    got = emit(files, plugin).select("file_id", "kind", "name").distinct()
    side = lambda rows, name: rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "name"))).alias(name))
    out = files.join(side(expected.exceptAll(got), "missing"), "file_id", "left").join(side(got.exceptAll(expected), "extra"), "file_id", "left")
    empty = F.array().cast("array<string>")
    return out.orderBy("file_id").select("text", F.coalesce("missing", empty).alias("missing"), F.coalesce("extra", empty).alias("extra"))
