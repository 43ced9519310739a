"""Scans of source trees and sinks: files by glob and size, language routing, names, manifests, documentation, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

MAX_BYTES = 1 << 20
#: Extensions and the languages they stand for, in the order they are tried.
LANGUAGES = {"pm": "perl", "pl": "perl", "t": "perl", "c": "cpp", "h": "cpp", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "py": "python", "r": "r", "cmake": "cmake"}
FILE_NAMES = {"CMakeLists.txt": "cmake"}


def language(path: Column, content: Column | None = None) -> Column:
    """By extension, then by file name, then by the first line."""
    name, ext = F.substring_index(path, "/", -1), F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    out = F.lit(None).cast("string")
    if content is not None:
        first = F.substring(F.decode(F.substring(content, 1, 64), "UTF-8"), 1, 64)
        out = F.when(first.rlike(r"^#!.*perl"), "perl").when(first.rlike(r"^#!.*python"), "python")
    for n, lang in FILE_NAMES.items():
        out = F.when(name == n, lang).otherwise(out)
    for e, lang in LANGUAGES.items():
        out = F.when(ext == e, lang).otherwise(out)
    return out


def scan_tree(spark: SparkSession, root: str, glob: str | None = None, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files, dropped): path, modified, bytes, lang, content of files up to max_bytes, and what was too large.

    Sizes and paths come from the listing; only files that stay are read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = reader.load(root).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), "content")
    dropped = rows.where(F.col("bytes") > max_bytes).select("path", "bytes")
    return rows.where(F.col("bytes") <= max_bytes).withColumn("lang", language(F.col("path"), F.col("content"))), dropped


def entry_scripts(files: DataFrame) -> DataFrame:
    """Files without an extension whose first line names an interpreter."""
    return files.where(~F.substring_index("path", "/", -1).contains(".") & F.decode(F.substring("content", 1, 64), "UTF-8").rlike("^#!"))


def module_names(files: DataFrame, roots: DataFrame) -> DataFrame:
    """name, path, ord: modules by their path below each search root (root, ord); no file is read."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    # a path meets the roots among the folders above it by equality
    modules = files.where(F.endswith("path", F.lit(".pm")) & F.contains("path", F.lit("/"))).select("path")
    under = modules.select("path", F.explode(above).alias("root")).join(roots, "root")
    rel = F.expr("substr(path, length(root) + 2)")
    return under.select(F.regexp_replace(F.regexp_replace(rel, r"\.pm$", ""), "/", "::").alias("name"), "path", "ord")


def providers(names: DataFrame, first_only: bool = False) -> DataFrame:
    """Every root that provides a module, in root order; or the first."""
    if first_only:
        return names.groupBy("name").agg(F.min_by("path", F.struct("ord", "path")).alias("path"), F.min("ord").alias("ord"))
    return names.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("ord", "path")))


def manifest_requires(manifests: DataFrame) -> DataFrame:
    """path, module of every requires 'X' line (path, text)."""
    return manifests.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*requires\s*\(?\s*['\"]([\w:]+)['\"]"), F.lit(1))).alias("module"))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def pod_items(docs: DataFrame) -> DataFrame:
    """name, doc of every =item of a text (text), the first of a name kept; a doc runs to the next command."""
    parts = docs.select(F.posexplode(F.split("text", r"(?m)^=item\s+")).alias("ord", "part")).where("ord > 0")
    name = F.regexp_extract("part", r"^(\w+)", 1)
    doc = _stripped(F.regexp_replace(F.regexp_replace("part", r"^[^\n]*\n?", ""), r"(?ms)^=(head|back|over|cut).*", ""))
    found = parts.select(name.alias("name"), doc.alias("doc"), "ord").where("name <> ''")
    return found.groupBy("name").agg(F.min_by("doc", "ord").alias("doc"))


def pod_to_markdown(text: Column) -> Column:
    """Headings, lists, bold, code and links of the documentation markup as Markdown."""
    steps = ((r"(?m)^=head1\s+(.*)$", "# $1"), (r"(?m)^=head2\s+(.*)$", "## $1"), (r"(?m)^=head3\s+(.*)$", "### $1"), (r"(?m)^=item\s+\*?\s*(.*)$", "- $1"), (r"(?m)^=(over|back|cut|pod|encoding).*$\n?", ""), (r"B<([^<>]*)>", "**$1**"), (r"I<([^<>]*)>", "*$1*"), (r"[CF]<([^<>]*)>", "`$1`"), (r"L<([^<>|]*)\|([^<>]*)>", "[$1]($2)"), (r"L<([^<>]*)>", "`$1`"))
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return _stripped(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines requests; missing fields take their defaults, malformed lines are kept apart in bad."""
    schema = "id string, q string, file string, line int, col int, query string, newname string, bad string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(path)
    return rows.fillna({"file": "", "line": 0, "col": 0})


def stamped(files: DataFrame) -> DataFrame:
    """A stamp of each file: hash of its modification time, and its size."""
    return files.withColumn("stamp", F.xxhash64("modified")).withColumn("size", F.col("bytes"))


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose stamp is the same before and after they were read."""
    return before.join(after.select("path", "stamp", "size"), ["path", "stamp", "size"], "left_semi")
