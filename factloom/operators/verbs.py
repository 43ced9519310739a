"""User-visible queries over the fact relations, each one plan: a target, its candidates, the exact match, order and cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.model import ACCESS
from factloom.operators import relational as R


def references(targets: DataFrame, refs: DataFrame | None, sites: DataFrame, declarations: DataFrame, files: DataFrame, mask: int) -> DataFrame:
    """target, file_id, pos, access: declarations and uses of each target (target, key) in the files (file_id, role) of the mask.

    The index (refs: key, file_id) narrows the files first; sites (file_id, key, pos, access) are then matched exactly.
    Without an index, sites are those of the targets' keys already.
    """
    visible = files.where(F.col("role").bitwiseAND(mask) != 0).select("file_id")
    if refs is not None:
        sites = sites.join(R.candidates(refs, targets.select("key").distinct()), "file_id", "left_semi")
    uses = sites.join(visible, "file_id", "left_semi").join(targets, "key").select("target", "file_id", "pos", "access")
    own = declarations.join(visible, "file_id", "left_semi").join(targets, "key").select("target", "file_id", "pos", F.lit(ACCESS["Declaration"]).alias("access"))
    return uses.unionByName(own).groupBy("target", "file_id", "pos").agg(F.max("access").alias("access"))


def rename_edits(references: DataFrame, rewritable: DataFrame, new_name: str) -> DataFrame:
    """Edits of a rename: references that may be rewritten; a target with a place that may not is refused as a whole.

    rewritable has (target, file_id, pos, ok).
    """
    marked = references.join(rewritable, ["target", "file_id", "pos"], "left").withColumn("ok", F.coalesce("ok", F.lit(True)))
    refused = marked.groupBy("target").agg(F.bool_or(~F.col("ok")).alias("bad")).where("bad").select("target")
    return marked.join(refused, "target", "left_anti").select("target", "file_id", "pos", F.lit(new_name).alias("new_text"))


def definition(lanes: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of the first lane that answers each key; lanes are in order of preference."""
    out = None
    for i, lane in enumerate(lanes):
        lane = lane.withColumn("lane", F.lit(i))
        out = lane if out is None else out.unionByName(lane)
    best = out.groupBy(*key).agg(F.min("lane").alias("lane"))
    return out.join(best, [*key, "lane"], "left_semi")


def highlights(references: DataFrame, asked: DataFrame) -> DataFrame:
    """The references within the files that are asked for (file_id)."""
    return references.join(asked.select("file_id").distinct(), "file_id", "left_semi")


def completion(sources: list[DataFrame], prefix: str, k: int = 200) -> DataFrame:
    """label, kind, priority of the k best candidates; the first source that has a label keeps it."""
    out = None
    for i, s in enumerate(sources):
        s = s.where(F.col("label").startswith(prefix)).withColumn("source", F.lit(i))
        out = s if out is None else out.unionByName(s)
    best = out.groupBy("label").agg(F.min(F.struct("source", "priority", "kind")).alias("x"))
    return best.select("label", "x.kind", "x.priority").orderBy("priority", "label").limit(k)


def outline(syms: DataFrame) -> DataFrame:
    """file_id and its symbols nested under their kind, each list in order of place."""
    per = syms.groupBy("file_id", "kind").agg(F.array_sort(F.collect_list(F.struct("start_at", "key"))).alias("symbols"))
    return per.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("kind", "symbols"))).alias("outline"))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that two paths to one answer do not share, with the side that has them; empty when they agree."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
