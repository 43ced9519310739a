"""Query of embedding whitening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm import whitening
from factloom.llm.common import table


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen whitened components of every vector (a deviation beyond a long is null)."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), 16)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "x")
    return out.select("vec_id", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "identity_error", each).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("x.whitened").alias("whitened"), F.col("x.explained").alias("explained"), "identity_error"
    )


QUERIES = {"op11_whitening": op11_whitening}
ORACLES: dict[str, str] = {}
