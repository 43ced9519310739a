"""Generations, validators, queues and the small rules of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factloom.model import REGRESSED

#: Search roots of a project, after a file's own.
PROJECT_ROOTS = ("lib", "local/lib/perl5")
#: Units of measurements, what they are reported in, and the factor between.
UNITS = {"ns": ("ms", 1e6), "KB": ("MB", 1024.0)}


def search_roots(own: DataFrame) -> DataFrame:
    """file_id, root, ord: the roots that a file names (file_id, line, root), then the project's."""
    per = own.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("line", "root"))).alias("x"))
    roots = F.concat(F.transform("x", lambda r: r["root"]), F.array(*map(F.lit, PROJECT_ROOTS)))
    return per.select("file_id", F.posexplode(roots).alias("ord", "root")).select("file_id", "root", "ord")


def write_generation(rows: DataFrame, path: str, generation: int) -> None:
    """Write the rows of a generation; readers don't see them before it is published."""
    rows.withColumn("generation", F.lit(generation)).write.mode("overwrite").parquet(f"{path}/generation-{generation}")


def publish(rows: DataFrame, path: str, generation: int) -> None:
    """Write a generation whole, then let the pointer name it: a rename, so that readers see the old or the new one, never a part."""
    write_generation(rows, path, generation)
    jvm = rows.sparkSession.sparkContext._jvm
    hadoop = rows.sparkSession.sparkContext._jsc.hadoopConfiguration()
    new = jvm.org.apache.hadoop.fs.Path(f"{path}/_current-{generation}")
    fs = new.getFileSystem(hadoop)
    fs.create(new, True).close()  # the highest published number is current, so that publishing needs no overwriting rename


def current(spark: SparkSession, path: str) -> int | None:
    """The published generation, or None."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_current-*")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return max((int(x.getPath().getName().rsplit("-", 1)[1]) for x in found or ()), default=None)


def published(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/generation-{current(spark, path)}")


def validated(tables: dict[str, tuple[DataFrame, str]], fingerprints: dict[str, str]) -> DataFrame:
    """name, wiped, n: of each derived table (rows, stored fingerprint) what is left when the fingerprint of now differs."""
    out = None
    for name, (rows, stored) in tables.items():
        wiped = fingerprints.get(name) != stored
        n = rows.where(F.lit(not wiped)).agg(F.count("*").alias("n"))
        one = n.select(F.lit(name).alias("name"), F.lit(wiped).alias("wiped"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def rederived(rows: DataFrame, order: str, baseline: int, again: DataFrame) -> DataFrame:
    """Rows before the baseline, and those made anew in place of the rest."""
    return rows.where(F.col(order) < baseline).unionByName(again)


def write_counters(samples: DataFrame, path: str) -> None:
    """Counters (name, n, total) of samples (name, value) as JSON lines."""
    samples.groupBy("name").agg(F.count("*").alias("n"), F.sum("value").alias("total")).write.mode("overwrite").json(path)


def next_to_resolve(asked: DataFrame, k: int) -> DataFrame:
    """name, lane, place: the first k of the distinct names (name, lane, arrival) by their best lane, then by arrival."""
    once = asked.groupBy("name").agg(F.min("lane").alias("lane"), F.min("arrival").alias("first"))
    first = once.orderBy("lane", "first", "name").limit(k)  # the cut is made before one task sees the rows
    ranked = F.array_sort(F.collect_list(F.struct("lane", "first", "name")))
    return first.agg(ranked.alias("x")).select(F.posexplode("x").alias("place", "x")).select("x.name", "x.lane", (F.col("place") + 1).cast("long").alias("place"))


def readiness(ready: Column, policy: Column, waited: Column, limit: Column) -> Column:
    """complete where all is known; a complete answer waits up to its limit; an interactive one is given with what there is."""
    return F.when(ready, "complete").when((policy == "complete") & (waited < limit), "wait").otherwise("partial")


def verdict_first(rows: DataFrame, ids: list[str], k: int) -> DataFrame:
    """The first k rows: regressions before all else, then by relative size of the change (null last), then by id."""
    size = F.try_divide(F.abs("delta"), F.nullif("base", F.lit(0)))
    return rows.orderBy((F.col("verdict") == REGRESSED).desc(), size.desc_nulls_last(), *ids).limit(k)


def settled(rows: DataFrame) -> DataFrame:
    """Measurements in the units of the reports."""
    unit, value = F.col("unit"), F.col("value").cast("double")
    for old, (new, factor) in UNITS.items():
        value, unit = F.when(F.col("unit") == old, F.col("value") / factor).otherwise(value), F.when(F.col("unit") == old, new).otherwise(unit)
    return rows.withColumns({"value": value, "unit": unit})


def folded(answers: DataFrame) -> DataFrame:
    """uri, line and empty of answers that are a location, a list of locations or of links, or null; the first counts."""
    start = "struct<start:struct<line:int,character:int>>"
    shape = f"struct<uri:string,range:{start},targetUri:string,targetRange:{start}>"
    many = F.when(F.col("answer").startswith("["), F.col("answer")).when(F.col("answer").startswith("{"), F.concat(F.lit("["), "answer", F.lit("]"))).otherwise("[]")
    first = answers.withColumn("x", F.get(F.from_json(many, f"array<{shape}>"), 0))
    rest = [c for c in answers.columns if c != "answer"]
    return first.select(*rest, F.coalesce("x.uri", "x.targetUri").alias("uri"), F.coalesce("x.range.start.line", "x.targetRange.start.line").alias("line"), F.col("x").isNull().alias("empty"))


def guard_message(verdict: Column, var: Column, tested: Column) -> Column:
    always = F.concat(var, F.lit(" is always "), tested, F.lit(" here: the guard is redundant"))
    never = F.concat(var, F.lit(" is never "), tested, F.lit(" here: the guard contradicts what is known"))
    return F.when(verdict == "redundant-guard", always).when(verdict == "contradictory-guard", never)


def differences(left: DataFrame, right: DataFrame, verb: str) -> DataFrame:
    """Rows that one side lacks, with the side that has them, among the verbs that both serve."""
    both = left.select(verb).distinct().join(right.select(verb).distinct(), verb)
    a, b = left.join(both, verb, "left_semi"), right.join(both, verb, "left_semi")
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
