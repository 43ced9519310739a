"""Certificates fall by each kind of change and by no other; an overlay derives its frontier and nothing else."""

import random

from pyspark.sql import functions as F

from factloom.operators import closedness as C
from factloom.streaming import changes, overlay as O

EDGES = [("a", "b"), ("b", "c"), ("x", "y"), ("w", "b")]
PROVIDERS = [("a", "fa", 1), ("b", "fb", 1), ("b", "fb", 1), ("b", "gb", 2), ("x", "fx", 1), ("y", "fy", 1), ("w", "fw", None), (None, "fn", 1)]


def _world(spark, providers=PROVIDERS, edges=EDGES):
    p = spark.createDataFrame(providers, "name string, path string, fingerprint long")
    return spark.createDataFrame([(s, t, 0) for s, t in edges], "src string, dst string, ord int"), p


def _names(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def _classes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "origin string")


def test_certificates(spark):
    edges, providers = _world(spark)
    none = _names(spark, [])
    certs, declined = C.mint(_classes(spark, ["a", "x", "w", "a", None]), edges, providers, none)
    assert {(r.origin, r.name, r.n) for r in certs.collect()} == {("a", "a", 1), ("a", "b", 2), ("a", "c", 0), ("x", "x", 1), ("x", "y", 1)}
    assert [tuple(r) for r in declined.collect()] == [("w", "unvouched")]

    def fallen(touched, *changed, gone=(), bridged=()):
        rows = [p for p in PROVIDERS if p[:2] not in gone and p[:2] not in {c[:2] for c in changed}] + list(changed)
        return {r.origin for r in C.broken(certs, _names(spark, touched), _world(spark, rows)[1], _names(spark, bridged)).collect()}

    assert fallen(["b", "c", "q"]) == set()  # touched, and what it was
    assert fallen(["c"], ("c", "fc", 1)) == {"a"}  # a first provider arrives
    assert fallen(["b"], ("b", "hb", 1)) == {"a"}  # another one
    assert fallen(["b"], gone=[("b", "gb")]) == {"a"}
    assert fallen(["y"], ("y", "fy", 2)) == {"x"}
    assert fallen(["y"], ("y", "fy", None)) == {"x"}
    assert fallen(["x"], bridged=["x"]) == {"x"}
    assert fallen(["q"], ("q", "fq", 1)) == set()


def test_declines(spark):
    chain = [(f"n{k}", f"n{k + 1}") for k in range(30)]
    edges, providers = _world(spark, edges=chain)
    classes = _classes(spark, ["n0", "n25"])
    _, deep = C.mint(classes, edges, providers, _names(spark, []))
    _, wide = C.mint(classes, edges, providers, _names(spark, []), most=4, max_depth=40)
    _, bridged = C.mint(classes, edges, providers, _names(spark, ["n3"]), max_depth=40)
    assert [[tuple(r) for r in x.collect()] for x in (deep, bridged)] == [[("n0", "deep")], [("n0", "bridged")]]
    assert {tuple(r) for r in wide.collect()} == {("n0", "wide"), ("n25", "wide")}


def test_consult_walks_only_what_fell(spark):
    edges, providers = _world(spark)
    none = _names(spark, [])
    certs, _ = C.mint(_classes(spark, ["a", "x"]), edges, providers, none)
    after = _world(spark, [*PROVIDERS, ("c", "fc", 1)])[1]
    state, now = C.consult(_classes(spark, ["a", "x", "w", "b"]), certs, _names(spark, ["c"]), edges, after, none)
    assert {tuple(r) for r in state.collect()} == {("a", "minted"), ("x", "kept"), ("w", "unvouched"), ("b", "minted")}
    assert C.broken(now, _names(spark, ["a", "b", "c", "x", "y"]), after, none).count() == 0


def _sums(requires):
    """A reader's value: the sum of its providers' values, 9 at most."""

    def derive(asked, values):
        r = requires.distinct().join(asked.withColumnRenamed("key", "reader"), "reader", "left_semi").join(values.withColumnRenamed("key", "provider"), "provider")
        return r.groupBy(F.col("reader").alias("key")).agg(F.least(F.sum("value"), F.lit(9)).alias("value"))

    return derive


def test_overlay_derives_its_frontier(spark):
    rng = random.Random(5)
    pairs = {(r, rng.randrange(r)) for r in range(4, 24) for _ in range(2)}
    base = {k: rng.randrange(4) for k in range(4)}

    def whole(of):
        out = dict(of)
        for k in range(4, 24):
            out[k] = min(9, sum(out[p] for r, p in pairs if r == k))
        return out

    requires = spark.createDataFrame([*pairs, *list(pairs)[:3]], "reader long, provider long")
    values = spark.createDataFrame(list(base.items()), "key long, value long")
    first = O.refresh(requires, values, spark.createDataFrame([], "key long, seal decimal(38,0)"), values, _sums(requires))
    assert first.settled and dict(map(tuple, first.values.collect())) == whole(base)
    later = {**base, 2: base[2] + 1}
    view = O.refresh(requires, O.replaced(first.values, spark.createDataFrame([(2, later[2])], "key long, value long")), first.seals, spark.createDataFrame([(2,)], "key long"), _sums(requires))
    assert view.settled and dict(map(tuple, view.values.collect())) == whole(later)
    # by hand, round by round: who reads a value that moved
    now, frontier, n = {**whole(base), 2: later[2]}, {2}, 0
    got = {}
    for r in view.derived.collect():
        got.setdefault(r["round"], set()).add(r.key)
    while frontier:
        n += 1
        asked = {r for r, p in pairs if p in frontier}
        assert got.get(n, set()) == asked
        new = {k: min(9, sum(now[p] for r, p in pairs if r == k)) for k in asked}
        frontier = {k for k in asked if new[k] != now[k]}
        now |= new
    again = O.refresh(requires, view.values, view.seals, spark.createDataFrame([(2,), (3,)], "key long"), _sums(requires))
    assert again.settled and again.derived.count() == 0  # nothing moved


def test_overlay_without_end(spark):
    requires = spark.createDataFrame([("a", "b"), ("b", "a")], "reader string, provider string")
    values = spark.createDataFrame([("a", 0), ("b", 0)], "key string, value long")
    derive = lambda asked, values: requires.join(asked.withColumnRenamed("key", "reader"), "reader", "left_semi").join(values.withColumnRenamed("key", "provider"), "provider").select(F.col("reader").alias("key"), (F.col("value") + 1).alias("value"))
    assert not O.refresh(requires, values, spark.createDataFrame([], "key string, seal decimal(38,0)"), values, derive, max_rounds=3).settled


def test_flush_evaluates_its_readers_only(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("y", "z")], "src string, dst string")
    answers = spark.createDataFrame([(k, v) for k, v in zip("abcyz", (2, 1, 1, 5, 1))], "key string, answer int")
    asked = []

    def read(keys, now):
        asked.append({r.key for r in keys.collect()})
        return e.join(now, e["src"] == now["key"]).select(F.col("dst").alias("key"), "answer").join(keys, "key", "left_semi")

    got, done = changes.flush(e, answers, spark.createDataFrame([("a",)], "key string"), read)
    assert done and asked == [{"b"}, {"c"}, set()] and ("z", 1) in {tuple(r) for r in got.collect()}
