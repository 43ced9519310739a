"""Joins that meet by equality instead of comparing all: overlaps by bins, roots by the folders above a path."""

import random

from factloom.operators import spans as S
from factloom.sources import scans


def test_overlap_free(spark):
    rng = random.Random(3)
    some = lambda n: [(rng.choice([1, 2, None]), s, s + rng.choice([0, 1, 5, 90]), k) for k, s in enumerate(rng.randrange(300) for _ in range(n))]
    rows, others = some(150), some(40)
    rows += rows[:5]
    kind = "key int, start int, end int, id int"
    for width in (1, 16, 1000):
        got = S.overlap_free(spark.createDataFrame(rows, kind), spark.createDataFrame(others, kind), ["key"], width)
        want = [r for r in rows if not any(r[0] is not None and r[0] == o[0] and r[1] < o[2] and o[1] < r[2] for o in others)]
        assert got.columns == ["key", "start", "end", "id"]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    none = spark.createDataFrame([], kind)
    assert S.overlap_free(none, none, ["key"], 8).count() == 0


def test_module_names_below_roots(spark):
    paths = ["/a/lib/Foo/Bar.pm", "/a/lib/x/Baz.pm", "/a/library/No.pm", "/a/lib/no.txt", "top.pm", "rel/lib/Q.pm"]
    files = spark.createDataFrame([(p, "x") for p in paths], "path string, ord string")  # a clashing column
    roots = spark.createDataFrame([("/a/lib", 0), ("/a/lib/x", 1), ("rel/lib", 2), ("/a/li", 3)], "root string, ord int")
    got = {(r.name, r.ord) for r in scans.module_names(files, roots).collect()}
    assert got == {("Foo::Bar", 0), ("x::Baz", 0), ("Baz", 1), ("Q", 2)}
