"""Walks, folds, scans, streams and sinks on small fixtures."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.functions import extension as X, names as N, types as Ty
from factloom.operators import evidence as E, graph as G, relational as R, reports, sampling, warehouse as W
from factloom.sources import scans
from factloom.streaming import changes as C


def edges(spark, spec):
    rows = [(s, t, 1, i) for s, ts in spec.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "src string, dst string, kind int, ord int")


def order(spark, spec, origin, **how):
    out = G.depth_first(edges(spark, spec), spark.createDataFrame([(origin,)], "origin string"), **how)
    return [r.node for r in out.orderBy("rank").collect()]


DIAMOND = {"C": ["A", "B"], "A": ["Top"], "B": ["Top"], "Top": ["C"]}


def test_depth_first_orders(spark):
    assert order(spark, DIAMOND, "C") == ["A", "Top", "B"]
    assert order(spark, {"A": ["B", "C"], "B": ["D"], "C": ["E"]}, "A", prune=("B",)) == ["B", "C", "E"]
    # D is marked when C is visited, so it comes after F although E leads to it
    assert order(spark, {"C": ["A", "D"], "A": ["E", "F"], "E": ["D"]}, "C") == ["A", "E", "F", "D"]
    assert len(order(spark, {"r": [f"c{i}" for i in range(300)]}, "r")) == 300
    assert order(spark, {"A": []}, "A") == []


def test_closure_bounds(spark):
    chain = edges(spark, {f"n{i:02d}": [f"n{i + 1:02d}"] for i in range(30)})
    out = G.closure(chain, spark.createDataFrame([("n00",)], "origin string"), max_depth=20, include_self=True).collect()
    assert len(out) == 21 and [r.node for r in out if r.truncated] == ["n20"]
    loop = G.closure(edges(spark, DIAMOND), spark.createDataFrame([("C",)], "origin string")).collect()
    assert {(r.node, r.depth) for r in loop} == {("A", 1), ("B", 1), ("Top", 2)}


def test_chains_with_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    assert {(r.src, r.terminal) for r in G.resolve_chains(links, 4).collect()} == {("a", "c"), ("b", "c"), ("x", None), ("y", None)}


@pytest.mark.parametrize(
    "types,want",
    [
        (["Class:A", "Class:A"], "Class:A"), (["Hash{a}", "Hash{b}"], "HashRef"), (["ArrayRef", "Sequence(a)"], "ArrayRef"), (["Bool", "Numeric"], "Numeric"),
        (["Class:A", "HashRef"], "Class:A"), (["Class:A", "String"], None), (["Class:A", None], "Optional<Class:A>"), ([None], None), (["Class:A", "Class:B"], "Class:B"), (["Optional<X>", None], "Optional<X>"),
    ],
)
def test_return_arms(spark, types, want):
    df = spark.createDataFrame(list(enumerate(types)), "seq long, type string")
    assert df.agg(E.return_arms(F.col("type"), F.col("seq"))).first()[0] == want


def test_other_folds(spark):
    df = spark.createDataFrame([(1, "Class:A", 10, False), (2, "Class:B", 20, False), (3, "Class:C", 20, True), (4, "Numeric", 10, True)], "seq long, type string, priority int, fallback boolean")
    t, s = F.col("type"), F.col("seq")
    got = df.agg(E.override(t, F.col("priority"), s), E.latest(t, s), E.slot(t, s), E.branch_arms(t, s, F.col("fallback")), E.branch_arms(t, s, F.lit(False))).first()
    assert tuple(got) == ("Class:C", "Numeric", None, "Class:C", None)
    votes = spark.createDataFrame([("f", "X"), ("f", "X"), ("f", None), ("g", "X"), ("g", None), ("h", "X"), ("i", "B"), ("i", "A"), ("i", "B")], "k string, v string")
    assert {tuple(r) for r in E.majority(votes, ["k"], "v").collect()} == {("f", "X", 2, 3), ("i", "B", 2, 3)}


def test_unused_exports_and_three_values(spark):
    syms = spark.createDataFrame([(1, "a", 9), (1, "b", 9), (2, "c", 1), (2, "d", 9)], "file_id long, key string, flags int")
    refs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "file_id long, key string")
    assert {tuple(r) for r in R.unused_exports(syms, refs).collect()} == {(1, "a"), (2, "d")}
    probes = spark.createDataFrame([(1, "a"), (1, "z"), (9, "a")], "file_id long, key string")
    assert {(r.file_id, r.key): r.found for r in R.exists3(syms, probes, syms, ["file_id", "key"]).collect()} == {(1, "a"): True, (1, "z"): False, (9, "a"): None}


def test_shred_replaces_only_its_buckets(spark, tmp_path):
    files = spark.createDataFrame([(1,), (2,)], "file_id long")
    R.shred(files, spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "file_id long, key string"), str(tmp_path / "refs"))
    R.shred(files.where("file_id = 2"), spark.createDataFrame([(2, "c")], "file_id long, key string"), str(tmp_path / "refs"))
    got = {(r.file_id, r.key) for r in spark.read.parquet(str(tmp_path / "refs")).collect()}
    assert (1, "a") in got and (2, "c") in got and (2, "b") not in got


def test_intern_is_dense_and_ordered(spark):
    words = [(w,) for w in ("b", "a", "c", "a", None)]
    assert sorted(tuple(r) for r in R.intern(spark.createDataFrame(words, "w string"), "w", 3).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_scans(spark, tmp_path):
    (tmp_path / "lib/Foo").mkdir(parents=True)
    (tmp_path / "lib/Foo/Bar.pm").write_text("package Foo::Bar;\n")
    (tmp_path / "run").write_text("#!/usr/bin/perl\n")
    (tmp_path / "big.py").write_text("x" * 200)
    (tmp_path / "CMakeLists.txt").write_text("project(x)")
    files, dropped = scans.scan_tree(spark, str(tmp_path), max_bytes=100)
    assert {r.path.rsplit("/", 1)[-1]: r.lang for r in files.collect()} == {"Bar.pm": "perl", "run": "perl", "CMakeLists.txt": "cmake"}
    assert [r.bytes for r in dropped.collect()] == [200] and [r.path.rsplit("/", 1)[-1] for r in scans.entry_scripts(files).collect()] == ["run"]
    roots = spark.createDataFrame([(f"file:{tmp_path}/lib", 0)], "root string, ord int")
    assert [r.name for r in scans.providers(scans.module_names(files, roots), first_only=True).collect()] == ["Foo::Bar"]
    stamped = scans.stamped(files)
    assert scans.unchanged(stamped, stamped).count() == 3


def test_documents_and_manifests(spark):
    pod = "=head1 NAME\n\n=over\n\n=item abs VALUE\n\nReturns B<it>.\n\n=item chop\n\nCuts.\n\n=back\n"
    df = spark.createDataFrame([(pod,)], "text string")
    assert {r.name: r.doc for r in scans.pod_items(df).collect()} == {"abs": "Returns B<it>.", "chop": "Cuts."}
    assert "**it**" in df.select(scans.pod_to_markdown(F.col("text"))).first()[0]
    man = spark.createDataFrame([("cpanfile", "requires 'A::B';\n# requires 'no'\nrequires \"C\", 1;")], "path string, text string")
    assert sorted(r.module for r in scans.manifest_requires(man).collect()) == ["A::B", "C"]


def test_requests_and_warehouse(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id":"1","q":"references","line":3}\nnot json\n')
    got = scans.read_requests(spark, str(tmp_path / "q.jsonl")).collect()
    assert [(r.id, r.file, r.line) for r in got if r.bad is None] == [("1", "", 3)] and sum(r.bad is not None for r in got) == 1
    lines = [{"t": "run", "run_id": "r", "ts": "2024-01-01T00:00:00", "dirty": False, "loadavg_at_start": 0.5}] + [{"t": "m", "run_id": "r", "corpus": "c", "name": "x", "value": float(v)} for v in (1, 2, 9)]
    (tmp_path / "w.jsonl").write_text("\n".join(map(json.dumps, lines)))
    runs, m = W.load(spark, [str(tmp_path / "w.jsonl")])
    assert W.trustworthy(runs).count() == 1 and tuple(W.headline(m, ["corpus", "name"]).first())[2:6] == (3, 2.0, 1.0, 9.0)


def test_report_sinks(spark, tmp_path):
    syms = spark.createDataFrame([(1, "add", 1, 0, 9), (1, "orphan", 1, 5, 1), (1, "main", 1, 9, 1), (2, "Pkg", 3, 0, 1), (2, "lonely", 1, 3, 9)], "file_id long, key string, kind int, start_at int, flags int")
    uses = spark.createDataFrame([(2, "add", 2)], "file_id long, key string, n long")
    heat = reports.heatmap(syms, uses)
    rows = {r.key: r for r in heat.collect()}
    assert rows["add"].fan_in == 2 and rows["orphan"].dead_code_candidate and rows["main"].reachable_guard == "entry-point" and rows["Pkg"].reachable_guard == "package-implicit-use"
    assert rows["lonely"].dead_export and not rows["lonely"].dead_code_candidate and not rows["add"].dead_export
    for kind in ("json", "csv", "html"):
        reports.write_report(heat, str(tmp_path / kind), kind)
        assert spark.read.text(str(tmp_path / kind)).count() >= 5


def test_names_and_types(spark):
    one = spark.range(1)
    check = lambda c: one.select(c).first()[0]
    assert check(N.match_key(F.lit("$Foo::x"))) == "$x" and check(N.match_key(F.lit("Foo::bar"))) == "bar"
    assert check(N.is_call(F.lit("a foo (1)"), F.lit("foo"))) and not check(N.is_call(F.lit("a foo"), F.lit("foo")))
    assert check(N.signature(F.lit("m"), F.array(F.lit("$self"), F.lit("$x")), F.lit(True))) == "m($x)"
    assert check(Ty.subsumes(F.lit("HashRef"), F.lit("Hash{a}"))) and not check(Ty.subsumes(F.lit("Bool"), F.lit("Numeric")))
    assert check(Ty.constraint(F.lit('InstanceOf["A::B"]'))) == "Class:A::B"


def test_samples(spark):
    df = spark.createDataFrame([(g, k, i) for g in "ab" for k, n in (("x", 50), ("y", 2)) for i in range(n)], "g string, k string, i int")
    got = sampling.round_robin_cap(df, ["g"], "k", F.col("i"), 6).groupBy("g", "k").count().collect()
    assert {(r.g, r.k): r["count"] for r in got} == {("a", "x"): 4, ("a", "y"): 2, ("b", "x"): 4, ("b", "y"): 2}
    cutoff = sampling.ranked_cut(df, [F.col("i"), F.col("k"), F.col("g")], 3).collect()
    assert len(cutoff) == 3 and all(r.incomplete for r in cutoff)


def test_pattern_expectations():
    with pytest.raises(ValueError):
        X.Pattern("p", "a(b)", "Symbol", {"ab": 2}).verify()
    with pytest.raises(ValueError):
        X.Pattern("p", "a(b)", "Nothing").verify()
    assert X.Plugin("a", ()).fingerprint() != X.Plugin("b", ()).fingerprint()


def test_stream_upserts_and_replay(spark, tmp_path):
    for i, rows in enumerate(([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (1, 3, "d")], [(2, 1, "b")])):
        spark.createDataFrame(pd.DataFrame(rows, columns=["key", "generation", "v"])).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = C.read_changes(spark, str(tmp_path / "in" / "*"), "key long, generation long, v string", 1)
    apply = C.upsert_batch(str(tmp_path / "out"), "key", "generation")
    C.maintain(stream, apply, str(tmp_path / "state")).awaitTermination()
    apply(spark.createDataFrame([(1, 3, "d")], "key long, generation long, v string"), 99)
    assert {(r.key, r.v) for r in C.latest(spark, str(tmp_path / "out"), "key", "generation").collect()} == {(1, "d"), (2, "b")}


def test_flush_goes_past_equal_neighbours(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    answers = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "key string, answer int")
    read = lambda keys, now: e.join(now, e["src"] == now["key"]).select(F.col("dst").alias("key"), "answer").join(keys, "key", "left_semi")
    got, done = C.flush(e, answers, spark.createDataFrame([("a",)], "key string"), read)
    assert done and {tuple(r) for r in got.collect()} == {("a", 2), ("b", 2), ("c", 2)}
    _, done = C.flush(e, answers, spark.createDataFrame([("a",)], "key string"), read, max_rounds=1)
    assert not done
