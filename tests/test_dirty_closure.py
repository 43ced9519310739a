"""The dirty closure on chains longer than any bound of other walks."""

from factloom.operators import graph as G


def test_every_consumer_however_far(spark):
    n = G.MAX_DEPTH + 5
    provides = spark.createDataFrame([(i, f"n{i}") for i in range(n)], "file long, name string")
    consumes = spark.createDataFrame([(i + 1, f"n{i}") for i in range(n)] + [(0, f"n{n - 1}"), (99, "other")], "file long, name string")
    changed = spark.createDataFrame([(0,)], "file long")
    assert sorted(r.file for r in G.dirty_closure(provides, consumes, changed).collect()) == list(range(1, n + 1))
