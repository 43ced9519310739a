"""Queries over programs that leave none out, however deeply it is nested."""

from factloom.operators import extract as X, navigate as N
from factloom.plans import registry
from factloom.sources import code

SF = "/root/testdata/sf0.001"


def deep_customers(spark):
    found = spark.read.parquet(f"{SF}/customer.parquet").where(f"c_custkey % {code.DEEP_EVERY} = {code.DEEP_REST}").collect()
    assert found
    return {r.c_custkey: r.c_nationkey for r in found}


def test_calls_of_deep_programs_are_stamped(spark):
    deep = deep_customers(spark)
    got = registry.queries()["stamped_calls"](spark, SF)
    assert got.select("file_id").distinct().count() == spark.read.parquet(f"{SF}/customer.parquet").count()
    for k, n in deep.items():
        c = f"Shop::C{k}"
        rows = got.where(f"file_id = {k}").orderBy("line").collect()
        assert [tuple(r)[1:] for r in rows] == [
            (24, "$self", f"stop_{n}", c, k, 42), (32, c, "new", c, k, 12), (33, "$obj", "owner", c, k, 9), (34, "$who", "isa", f"Shop::C{n}", None, None), (35, "$who", "pay", "Shop::R", None, None), (38, "$self", "on", c, None, None)
        ]


def test_calls_in_and_behind_nested_blocks(spark):
    text = "package D;\nsub go { }\nsub run {\n    my ($self) = @_;\n" + "{\n" * 300 + "$self->go;\n" + "}\n" * 300 + "    $self->go;\n}\nsub more { my ($self) = @_; $self->run; }\n"
    every = X.statements(spark.createDataFrame([(1, text)], "file_id long, text string"))
    assert every.first().deepest > X.MAX_DEPTH
    assert sorted(tuple(r) for r in N.stamped_calls(every).select("line", "name", "class", "def_line").collect()) == [(304, "go", "D", 1), (605, "go", "D", 1), (607, "run", "D", 2)]


def test_mentions_of_deep_programs_are_typed(spark):
    deep = deep_customers(spark)
    got = registry.queries()["type_at"](spark, SF)
    assert got.where("file_id >= 0").select("file_id").distinct().count() == spark.read.parquet(f"{SF}/customer.parquet").count()
    for k, n in deep.items():
        c, m = f"Shop::C{k}", f"Shop::C{n}"
        rows = got.where(f"file_id = {k}").collect()
        assert sorted((r.line, r.var, r.type) for r in rows) == sorted(
            [(line, "$self", c) for line in (14, 15, 18, 24, 37, 38, 42)] + [(13, "$class", c), (14, "$class", c), (32, "$obj", c), (33, "$obj", c), (33, "$who", m), (34, "$who", m), (35, "$who", "Shop::R"), (27, "$x", "HashRef"), (28, "$x", "Num"), (29, "$x", "Num"), (35, "$y", "Defined")]
        )


def test_types_in_and_behind_nested_blocks(spark):
    text = "package D;\nsub run {\n    my ($self, $x) = @_;\n    $x = 1;\n" + "{\n" * 300 + "if (defined $x) {\nf($x);\n}\nf($x);\n" + "}\n" * 300 + "    f($x, $self);\n}\n"
    every = X.statements(spark.createDataFrame([(1, text)], "file_id long, text string"))
    assert every.first().deepest > X.MAX_DEPTH
    got = {(r.line, r.var): r.type for r in N.type_at(every).collect()}
    assert got == {(2, "$self"): "D", (3, "$x"): "Num", (304, "$x"): "Num", (305, "$x"): "Defined", (307, "$x"): "Num", (608, "$x"): "Num", (608, "$self"): "D"}
