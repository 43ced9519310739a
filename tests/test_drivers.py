"""Languages as data sources: claims, partitions, filters that spare files, and streams of changes."""

import os

import pytest
from pyspark.sql import functions as F

from factloom.sources import drivers as D

TREE = {
    "lib/A.pm": "package A;\nuse Carp;\nuse parent qw(\n  B C);\nsub run { 1 }\n=head1 X\n\nsub no {}\n",
    "lib/deep/B.pm": "package A::B { sub x; sub y { } }",
    "py/m.py": "import os\nclass K(Base):\n    def go(self): pass\n",
    "CMakeLists.txt": "find_package(Z)\n",
    "README": "nothing\n",
    "empty.pm": "",
}


@pytest.fixture()
def root(tmp_path):
    for name, text in TREE.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.pm").write_bytes(b"package X; \xff")
    (tmp_path / "big.pm").write_text("package Big;\n" + "# x\n" * 1000)
    return tmp_path


def rows(df, root):
    return sorted((os.path.relpath(r.path, root), r.lang, r.line, r.kind, r.name) for r in df.collect())


WANT = [
    ("CMakeLists.txt", "cmake", 0, "import", "Z"), ("bad.pm", "perl", 0, "not-analysed", "not UTF-8"), ("big.pm", "perl", 0, "not-analysed", "too large"), ("lib/A.pm", "perl", 0, "package", "A"), ("lib/A.pm", "perl", 1, "import", "Carp"),
    ("lib/A.pm", "perl", 2, "parent", "B"), ("lib/A.pm", "perl", 2, "parent", "C"), ("lib/A.pm", "perl", 4, "sub", "run"), ("lib/deep/B.pm", "perl", 0, "package", "A::B"), ("lib/deep/B.pm", "perl", 0, "sub", "x"), ("lib/deep/B.pm", "perl", 0, "sub", "y"),
    ("py/m.py", "python", 0, "import", "os"), ("py/m.py", "python", 1, "base", "Base"), ("py/m.py", "python", 1, "def.class", "K"), ("py/m.py", "python", 2, "def.sub", "go"),
]


def test_reads_a_tree(spark, root):
    D.register(spark)
    df = spark.read.format(D.FORMAT).option("maxBytes", 2000).option("partitionBytes", 40).load(str(root))
    assert rows(df, root) == sorted(WANT) and df.rdd.getNumPartitions() > 3
    assert rows(spark.read.format(D.FORMAT).load(str(root / "py" / "none")), root) == []


def test_filters_spare_files(root):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

    def files(*filters):
        reader = D._Reader({"path": str(root)}, D.BUNDLED)
        rest = list(reader.pushFilters(list(filters)))
        return rest, sorted(os.path.relpath(p, root) for x in reader.partitions() for p, _ in x.files)

    assert files(EqualTo(("lang",), "python")) == ([], ["py/m.py"])
    assert files(In(("lang",), ("cmake", "python"))) == ([], ["CMakeLists.txt", "py/m.py"])
    assert files(StringStartsWith(("path",), str(root / "lib"))) == ([], ["lib/A.pm", "lib/deep/B.pm"])
    kept = GreaterThan(("line",), 1)
    assert files(kept, EqualTo(("lang",), "cmake")) == ([kept], ["CMakeLists.txt"])


def test_filters_give_the_same_rows(spark, root):
    D.register(spark)
    df = spark.read.format(D.FORMAT).option("maxBytes", 2000).load(str(root))
    assert rows(df.where("lang = 'perl' and line > 1"), root) == sorted(r for r in WANT if r[1] == "perl" and r[2] > 1)
    assert rows(df.where(F.col("lang").isin("cmake", "python")), root) == sorted(r for r in WANT if r[1] != "perl")


def test_a_driver_of_ones_own(spark, root):
    own = D.Registry((D.PERL, D.Driver("words", lambda text: ((0, "word", w, None, None) for w in text.split()), takes_unclaimed=True)))
    D.register(spark, own, "own.source")
    df = spark.read.format("own.source").load(str(root))
    assert ("README", "words", 0, "word", "nothing") in rows(df, root) and {r.lang for r in df.collect()} == {"perl", "words"}
    with pytest.raises(ValueError, match="pm is claimed"):
        D.Registry((D.PERL, D.Driver("other", iter, ("pm",))))
    with pytest.raises(ValueError, match="unclaimed"):
        D.Registry(tuple(D.Driver(x, iter, takes_unclaimed=True) for x in "ab"))


def test_streams_changes(spark, root, tmp_path_factory):
    D.register(spark)
    place = tmp_path_factory.mktemp("stream")

    def run():
        stream = spark.readStream.format(D.FORMAT).load(str(root / "lib"))
        stream.writeStream.format("parquet").option("checkpointLocation", str(place / "c")).option("path", str(place / "out")).trigger(availableNow=True).start().awaitTermination(120)
        return rows(spark.read.parquet(str(place / "out")), root)

    first = run()
    assert first == sorted(r for r in WANT if r[0].startswith("lib/"))
    (root / "lib" / "New.pm").write_text("package New;\n")
    assert [r for r in run() if r not in first] == [("lib/New.pm", "perl", 0, "package", "New")]
    assert len(run()) == len(first) + 1


def test_texts_of_a_table(spark, root):
    df = spark.createDataFrame([(k, v) for k, v in TREE.items()] + [(None, None), ("x.pm", None)], "path string, text string")
    assert sorted((r.path, r.lang, r.line, r.kind, r.name) for r in D.analyzed(df).collect()) == sorted(r for r in WANT if r[0] in TREE)
