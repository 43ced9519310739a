"""Nested outlines, selection ranges and parameter hints, from statements with their scopes.

A file's declarations form a forest by the blocks they stand in. Statements come in order with their depth, so that one
ordered pass over a file, on the places of its blocks alone, gives every block the one around it; the rest is joins on
(file_id, block). Files are independent of each other; a task holds the heads and ends of a batch of files at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from factloom.operators import extract as X
from factloom.operators.graph import dealt, kept

#: Rounds in which parents are followed; deeper nesting is not analysed (see extract.MAX_DEPTH).
MAX_PARENTS = X.MAX_DEPTH


def blocks(rows: DataFrame) -> DataFrame:
    """file_id, block (place of its head), end (place of what closes it, or the one behind its file), start_line, end_line, parent (block around it, or null).

    A stack over the heads and ends of a file's blocks, in order of place; a block that never closes ends with its file.
    """
    code = X.live(rows).select("file_id", "at", "line", "end_line", "ends", F.expr("norm like '%{' and opens > closes - ends").alias("head"))
    mark = F.when(F.expr("ends > 0 or head"), F.struct("at", "line", "ends", "head"))
    marks = code.groupBy("file_id").agg(F.max("at").alias("last_at"), F.max("end_line").alias("last_line"), F.array_sort(F.collect_list(mark)).alias("marks"))
    found = "array<struct<block:int,end:int,start_line:int,end_line:int,parent:int>>"
    return marks.mapInArrow(_nested, f"file_id long, found {found}").select("file_id", F.inline("found"))


def _nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each file from its marks; a batch has many files."""
    names = ("block", "end", "start_line", "end_line", "parent")
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in names]))
    for batch in batches:
        files = []
        for marks, last_at, last_line in zip(*(batch.column(c).to_pylist() for c in ("marks", "last_at", "last_line")), strict=True):
            out, stack = [], []
            for m in marks:
                if m["ends"] and stack:
                    block, start, parent = stack.pop()
                    out.append((block, m["at"], start, m["line"], parent))
                if m["head"]:
                    stack.append((m["at"], m["line"], stack[-1][0] if stack else None))
            out += [(block, last_at + 1, start, last_line, parent) for block, start, parent in stack]
            files.append([dict(zip(names, x, strict=True)) for x in out])
        yield pa.RecordBatch.from_arrays([batch.column("file_id").cast(pa.int64()), pa.array(files, kind)], ["file_id", "found"])


def inner_block(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with block: the innermost block around each statement; a block's own head and end lie in the block around it."""
    marks = found.select("file_id", F.col("block").alias("at"), F.col("block").alias("enters"), F.lit(None).cast("int").alias("leaves"))
    ends = found.select("file_id", F.col("end").alias("at"), F.lit(None).cast("int").alias("enters"), F.col("parent").alias("leaves"))
    # what holds behind a place is the last block entered, or the one around the last block left
    state = marks.unionByName(ends).groupBy("file_id", "at").agg(F.coalesce(F.max("enters"), F.max(F.coalesce("leaves", F.lit(-1)))).alias("state"))
    w = Window.partitionBy("file_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    met = rows.join(dealt(state), ["file_id", "at"], "left")
    around = F.last("state", ignorenulls=True).over(w)
    closing = met.withColumn("block", F.nullif(around, F.lit(-1))).drop("state")
    parents = found.select("file_id", F.col("end").alias("at"), F.col("parent").alias("around"), F.lit(True).alias("is_end"))
    return closing.join(dealt(parents), ["file_id", "at"], "left").withColumn("block", F.when(F.col("is_end"), F.col("around")).otherwise(F.col("block"))).drop("around", "is_end")


def outline(rows: DataFrame) -> DataFrame:
    """file_id, at, line, kind, name, end_line, level, path: packages, subs and variables, each below the nearest declared block around it.

    A package declared by a statement holds what follows in its file, so that subs stand below it; level counts from 0 and
    path has the names from the outermost one on.
    """
    code = X.live(rows)
    kinds = {"package": r"^(?:package|class|role)\s+([\w:]+)", "sub": r"^(?:sub|method)\s+((?:\w+::)*\w+)", "variable": r"^(?:my|our|state)\s+([$@%]\w+)"}
    said = F.array(*[F.struct(F.lit(k).alias("kind"), X.got("norm", p).alias("name")) for k, p in kinds.items()])
    listed = F.transform(F.split(F.regexp_extract("norm", r"^(?:my|our|state)\s*\(([^)]*)\)", 1), r"\s*,\s*"), lambda v: F.struct(F.lit("variable").alias("kind"), F.nullif(v, F.lit("")).alias("name")))
    found = code.select("file_id", "at", "line", "package", "sub", F.posexplode(F.filter(F.concat(said, listed), lambda x: x["name"].isNotNull())).alias("i", "x")).select("file_id", "at", "i", "line", "x.kind", "x.name", "package", "sub")
    ends = blocks(rows).select("file_id", F.col("block").alias("at"), F.col("end_line").alias("closes"))
    found = found.join(dealt(ends), ["file_id", "at"], "left")
    above = F.when(F.col("kind") == "package", F.array()).when(F.col("kind") == "sub", F.array("package")).otherwise(F.filter(F.array("package", "sub"), lambda x: x.isNotNull()))
    path = F.concat(F.filter(above.cast("array<string>"), lambda x: x != "main"), F.array("name"))
    return found.select("file_id", "at", "i", "line", "kind", "name", F.coalesce("closes", "line").alias("end_line"), (F.size(path) - 1).alias("level"), path.alias("path"))


def selection_ranges(rows: DataFrame, points: DataFrame) -> DataFrame:
    """file_id, line, level, start_line, end_line: for each point (file_id, line) the statement and the blocks around it, innermost first.

    A line of several statements counts by its first. Parents are followed a round at a time, each a join on the block.
    """
    found = kept(blocks(rows))
    code = X.live(rows).select("file_id", "at", "line", "end_line")
    # a statement stands at each of its lines, so that a point meets what is there and not all of its file
    lines = code.withColumn("point", F.explode(F.sequence("line", "end_line")))
    first = points.select("file_id", F.col("line").alias("point")).distinct().join(dealt(lines), ["file_id", "point"]).groupBy("file_id", "point").agg(F.min(F.struct("at", "line", "end_line")).alias("x")).select("file_id", "point", "x.*")
    # the block around a place is told by the heads and ends before it
    places = first.select("file_id", "at").union(found.select("file_id", "block")).union(found.select("file_id", "end")).distinct()
    placed = inner_block(places, found).select("file_id", "at", "block")
    front = first.join(dealt(placed), ["file_id", "at"]).select("file_id", "point", "block", F.col("line").alias("start_line"), "end_line")
    out = front.select("file_id", "point", F.lit(0).alias("level"), "start_line", "end_line")
    around = found.select("file_id", F.col("block"), F.col("parent"), F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    state = front.select("file_id", "point", "block")
    for level in range(1, MAX_PARENTS + 1):
        met = kept(state.where("block is not null").join(dealt(around), ["file_id", "block"]))
        if met.isEmpty():
            break
        out = out.unionByName(met.select("file_id", "point", F.lit(level).alias("level"), F.col("s").alias("start_line"), F.col("e").alias("end_line")))
        state = met.select("file_id", "point", F.col("parent").alias("block"))
    return out.withColumnRenamed("point", "line")


def parameter_hints(rows: DataFrame) -> DataFrame:
    """file_id, line, name, slot, param, argument: arguments of a call of the package's own function with the parameter each fills.

    Arguments are cut at commas outside of brackets; a parameter of the same spelling needs no hint.
    """
    call = X.got("norm", r"(?<![\w$@%>:&])([a-z_]\w*)\((?:[^()]|\([^()]*\))*\)")
    inner = F.regexp_extract("norm", r"(?<![\w$@%>:&])[a-z_]\w*\(((?:[^()]|\([^()]*\))*)\)", 1)
    sent = X.live(rows).where(~F.col("norm").rlike(X.SUB)).select("file_id", "line", "package", call.alias("name"), inner.alias("args")).where("name is not null and args <> ''")
    parts = F.split("args", r",\s*(?![^(\[{]*[)\]}])")
    told = X.parameters(rows).select("package", F.col("sub").alias("name"), "params")
    each = sent.select("file_id", "line", "package", "name", F.posexplode(parts).alias("slot", "argument")).join(told, ["package", "name"])
    param = F.get("params", F.col("slot"))
    return each.where(param.isNotNull() & (F.trim("argument") != param)).select("file_id", "line", "name", "slot", param.alias("param"), F.trim("argument").alias("argument"))
