"""The extension surface: a registry of patterns and manifests, table functions that emit rows, reducers as aggregates."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType
from pyspark.sql.udf import UserDefinedFunction

#: What a table function may emit.
EMISSIONS = ("SetRouteBase", "Method", "HashKeyDef", "HashKeyAccess", "ImportRef", "PackageParent", "Handler", "DispatchCall", "PluginLoad", "MethodCallRef", "Diagnostic", "Symbol", "PluginNamespace", "FrameworkImport", "Import", "VarType", "NamedSubParamType", "SyntheticUse")


@dataclass(frozen=True)
class Pattern:
    """A capture pattern, what it emits (a kind of EMISSIONS) and snippets with the number of matches each must have."""

    name: str
    regex: str
    emits: str
    expect: dict[str, int] = field(default_factory=dict)

    def verify(self) -> None:
        if self.emits not in EMISSIONS:
            raise ValueError(f"{self.name}: no such emission: {self.emits}")
        for text, n in self.expect.items():
            found = len(re.findall(self.regex, text, re.M))
            if found != n:
                raise ValueError(f"{self.name}: {found} matches in {text!r}, not {n}")


@dataclass(frozen=True)
class Plugin:
    """Patterns behind a trigger: always, or files that use a module; and overrides of return types."""

    name: str
    patterns: tuple[Pattern, ...]
    uses: str | None = None
    overrides: dict[tuple[str, str], str] = field(default_factory=dict)

    def fingerprint(self) -> str:
        import hashlib

        said = json.dumps([self.name, self.uses, [(p.name, p.regex, p.emits) for p in self.patterns], sorted(map(str, self.overrides.items()))])
        return hashlib.sha256(said.encode()).hexdigest()


def emit(files: DataFrame, plugin: Plugin) -> DataFrame:
    """file_id, pattern, kind, name for every match in files (file_id, text) that the plugin's trigger lets through.

    The trigger filters before any pattern runs; each pattern is one native capture, and only its first group is computed.
    """
    for p in plugin.patterns:
        p.verify()
    if plugin.uses is not None:
        files = files.where(F.contains("text", F.lit(plugin.uses)))
    def rows(p: Pattern) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit("(?m)" + p.regex), F.lit(1)), lambda x: F.struct(F.lit(p.name).alias("pattern"), F.lit(p.emits).alias("kind"), x.alias("name")))

    each = [rows(p) for p in plugin.patterns]
    return files.select("file_id", F.explode(F.concat(*each)).alias("e")).select("file_id", "e.*")


def gated(emissions: DataFrame, isa: DataFrame) -> DataFrame:
    """Deferred emissions (class, gate, …) whose class turns out to descend from the gate: isa has (origin, node)."""
    return emissions.join(isa.select(F.col("origin").alias("class"), F.col("node").alias("gate")).distinct(), ["class", "gate"], "left_semi")


def with_overrides(types: DataFrame, plugins: list[Plugin]) -> DataFrame:
    """types (class, method, type) under the plugins' overrides; a later plugin wins. Manifests are declared tables."""
    rows = {k: v for p in plugins for k, v in p.overrides.items()}
    if not rows:
        return types
    entries = [F.struct(F.lit(c).alias("class"), F.lit(m).alias("method"), F.lit(t).alias("forced")) for (c, m), t in rows.items()]
    table = types.sparkSession.range(1).select(F.inline(F.array(*entries)))
    return types.join(F.broadcast(table), ["class", "method"], "left").withColumn("type", F.coalesce("forced", "type")).drop("forced")


@F.udtf(returnType="ordinal int, kind string, name string")
class Tokens:
    """LATERAL tokenizer for what no pattern expresses: words and balanced brackets, in order."""

    def eval(self, text: str):
        depth, n = 0, 0
        for m in re.finditer(r"[A-Za-z_]\w*|[()\[\]{}]", text or ""):
            t = m[0]
            if t in "([{":
                depth += 1
            elif t in ")]}":
                depth = max(0, depth - 1)
            else:
                yield n, f"depth{min(depth, 9)}", t
                n += 1


def register(spark: SparkSession) -> None:
    """Make the table function known to SQL."""
    spark.udtf.register("tokens", Tokens)


def _type_inner(spelt: pd.Series) -> pd.Series:
    """The innermost parameter of nested constraints, such as Maybe[ArrayRef[Int]]."""
    return spelt.map(lambda s: None if s is None else re.sub(r"\]+$", "", s).rsplit("[", 1)[-1])


def type_inner() -> UserDefinedFunction:
    return F.pandas_udf(_type_inner, StringType())


def argument_slot(text: Column) -> Column:
    """Separators of the outermost level in an argument list so far, outside of strings and of brackets however deep."""
    letters = F.split(F.regexp_replace(text, r"'[^']*'|\"[^\"]*\"", "''"), "")
    step = lambda a, c: F.struct(
        F.greatest(F.lit(0), a["depth"] + F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)).alias("depth"),
        (a["n"] + F.when((c == ",") & (a["depth"] == 0), 1).otherwise(0)).alias("n"),
    )
    return F.aggregate(letters, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n")), step)["n"]


def reducers(rows: DataFrame, key: str, ordered: list[Column]) -> DataFrame:
    """An ordered registry of aggregates over one pass; the first that is not null answers."""
    return rows.groupBy(key).agg(F.coalesce(*ordered).alias("value"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
