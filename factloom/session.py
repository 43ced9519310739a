"""Session construction for local runs; a cluster hands its own session to every operator."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one, on one machine only (as in tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has several machines' folders
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return tempfile.mkdtemp(prefix="factloom-")


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with AQE on and few shuffle partitions, for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
