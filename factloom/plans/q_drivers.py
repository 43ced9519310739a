"""Reading source trees through language drivers."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.plans.q_extract import PACKED, S
from factloom.plans.registry import register
from factloom.session import shared_folder
from factloom.sources import code, drivers as D

EXTENSIONS = {"python": "py", "cpp": "cpp", "r": "r", "cmake": "cmake"}


def tree(spark: SparkSession, d: str) -> DataFrame:
    """path, text of the suppliers' units and of the nations' programs."""
    extension = F.create_map(*[F.lit(x) for p in EXTENSIONS.items() for x in p])
    units = code.units(spark, d).select(F.concat("lang", F.lit("/"), F.col("file_id").cast("string"), F.lit("."), extension[F.col("lang")]).alias("path"), "text")
    return units.unionByName(code.programs(spark, d).where("file_id < 0").select("path", "text"))


DRIVEN = f"""WITH {S} SELECT x.lang || '/' || k || '.' || CASE x.lang WHEN 'python' THEN 'py' ELSE x.lang END AS path, x.lang, x.line, x.capture AS kind, x.name FROM s, LATERAL (VALUES {PACKED}) AS x(lang, line, capture, name)
UNION ALL SELECT 'lib/Shop/N' || n_nationkey || '.pm', 'perl', x.* FROM nation, LATERAL (VALUES (0, 'package', 'Shop::N' || n_nationkey), (2, 'sub', 'base_' || n_nationkey)) AS x(line, kind, name)"""


@register("driver_facts", DRIVEN)
def driver_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a source tree in five languages, read through the registered format.

    Executors open the files, so the tree is written only where the shared folder is a path of theirs; the drivers read the
    texts from the table where it is not.
    """
    shared = shared_folder(spark)
    if re.match(r"\w+:", shared) and not shared.startswith("file:"):
        rows = D.analyzed(tree(spark, d))
    else:
        root = re.sub(r"^file:(//)?", "", shared) + f"/tree-{uuid.uuid4().hex}"
        D.write_tree(tree(spark, d), root)
        D.register(spark)
        rows = spark.read.format(D.FORMAT).load(root).withColumn("path", F.substring("path", len(root) + 2, 1000))
    return rows.select("path", "lang", "line", "kind", "name")
