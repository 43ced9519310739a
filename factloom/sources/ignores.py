"""Scans of source trees that heed ignore files, before any file's content is read.

Each directory may hold ignore files. A rule there holds for everything below; a later line goes before an earlier one, a
deeper directory's rules before those above, and a rule with an exclamation mark takes back. What lies in an ignored
directory is ignored whatever deeper rules say. All paths and the directories above them are judged at once: each meets the
rules of the directories above it by an equality join on the directory, and an aggregate keeps the last rule that matches.

Defined results: blank lines, comments and lines that are no valid pattern are no rules; a trailing blank counts only behind
a backslash; two rules that match at the same place are decided by the later line; files named twice are judged once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.sources.scans import MAX_BYTES, language

#: Names of ignore files, the one that goes before the other last.
NAMES = (".gitignore", ".ignore")
RULES = "dir string, depth int, rank int, line int, taken_back boolean, only_dirs boolean, regex string"


def compiled(line: str) -> tuple[bool, bool, str] | None:
    """(taken back, for directories only, a pattern for paths relative to the rule's directory) of a line; None if it is no rule."""
    line = line.rstrip("\r")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[1:] if back else line
    only_dirs = line.endswith("/")
    line = line.rstrip("/") if only_dirs else line
    if not line:
        return None
    anchored, line = "/" in line, line.removeprefix("/")
    out, i = "", 0
    while i < len(line):
        rest = line[i:]
        if rest.startswith("**/") and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif rest == "**" and (i == 0 or line[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif rest[0] == "*":
            while i < len(line) and line[i] == "*":
                i += 1
            out += "[^/]*"
        elif rest[0] == "?":
            out, i = out + "[^/]", i + 1
        elif rest[0] == "[" and (m := re.match(r"\[([!^]?)(\]?(?:\\.|[^\]\\])*)\]", rest)):
            inner = m[2].replace("[", r"\[").replace("&", r"\&")
            inner = r"\]" + inner[1:] if inner.startswith("]") else inner
            out, i = out + f"(?!/)[{'^' if m[1] else ''}{inner}]", i + m.end()
        elif rest[0] == "[":
            return None
        elif rest[0] == "\\" and len(rest) > 1:
            out, i = out + re.escape(rest[1]), i + 2
        elif rest == "\\":
            return None
        else:
            out, i = out + re.escape(rest[0]), i + 1
    return back, only_dirs, ("" if anchored else "(?:.*/)?") + out


def rules(ignores: DataFrame) -> DataFrame:
    """The rules (RULES) of ignore files (path, relative to the root; text)."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, text in part[["path", "text"]].itertuples(index=False):
                where, _, name = path.rpartition("/")
                for number, line in enumerate((text or "").split("\n")):
                    if (found := compiled(line)) is not None:
                        rows.append((where, where.count("/") + bool(where), NAMES.index(name) if name in NAMES else 0, number, *found))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RULES.split(", ")])

    return ignores.select("path", "text").mapInPandas(read, RULES)


def ignored(paths: DataFrame, found: DataFrame) -> DataFrame:
    """path of those paths (of files, relative to the root) that the rules leave out."""
    parts = F.split("path", "/")
    upto = lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/")
    own = paths.select("path").distinct().withColumn("parts", parts)
    places = own.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.struct(upto(n).alias("place"), (n < F.size("parts")).alias("is_dir")))).alias("x")).select("path", "x.*")
    # every directory is judged once, however many files it holds
    judged = places.select("place", "is_dir").distinct().withColumn("parts", F.split("place", "/"))
    above = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(upto(F.greatest(n, F.lit(1)))))
    met = judged.select("place", "is_dir", F.explode(above).alias("dir")).join(found, "dir").where(F.col("is_dir") | ~F.col("only_dirs"))
    relative = F.when(F.col("dir") == "", F.col("place")).otherwise(F.expr("substr(place, length(dir) + 2)"))
    hits = met.where(F.rlike(relative, F.concat(F.lit("^(?:"), "regex", F.lit(")$"))))
    last = hits.groupBy("place", "is_dir").agg(F.max_by("taken_back", F.struct("depth", "rank", "line")).alias("taken_back")).where(~F.col("taken_back"))
    return places.join(last, ["place", "is_dir"], "left_semi").select("path").distinct()


def scan_heeding(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files, dropped) below a root: path, modified, bytes, lang of files that no rule leaves out; and those too large.

    The listing names paths and sizes, without files whose names begin with a dot or an underscore; of contents only those of
    the ignore files are read. ``contents`` reads what stays.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    base = re.sub(r"^file:/+", "/", root).rstrip("/")
    relative = F.substring(F.regexp_replace("path", r"^file:/+", "/"), len(base) + 2, 1 << 20)
    listing = reader.load(root).select(relative.alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(n, F.lit(1))), "/"), F.lit("/"))))
    held = listing.select(F.explode(folders).alias("folder")).distinct()
    named = held.select(F.explode(F.array(*[F.concat("folder", F.lit(n)) for n in NAMES])).alias("path"))  # a listing leaves out names that begin with a dot
    texts = contents(named, root).where("content is not null").select("path", F.decode("content", "UTF-8").alias("text"))
    kept = listing.join(ignored(listing, rules(texts)), "path", "left_anti")
    dropped = kept.where(F.col("bytes") > max_bytes).select("path", "bytes")
    return kept.where(F.col("bytes") <= max_bytes).withColumn("lang", language(F.col("path"))), dropped


def contents(files: DataFrame, root: str) -> DataFrame:
    """files (path, relative to the root) with their content, opened by the executors one at a time; null where a file has gone."""
    from pyarrow import fs

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root if re.match(r"\w+:", root) else f"file://{root}")
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                try:
                    with store.open_input_stream(f"{base}/{one.column('path')[0].as_py()}") as f:
                        content = f.read()
                except FileNotFoundError:
                    content = None
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([content], pa.binary())], [*one.schema.names, "content"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(read, f"{kept}, content binary")
