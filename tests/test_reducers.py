"""Return expressions and the ladder of reducers on cases written by hand."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import reducers as R

NODE = R.NODES


def nodes_of(spark, rows):
    return spark.createDataFrame([(n, op, t, i, kids) for n, op, t, i, kids in rows], NODE)


TREES = [
    (1, "union", None, None, [("empty", 0, 2), ("at_least", 1, 3)]), (2, "concrete", "String", None, []), (3, "receiver", None, None, []),  # a getter that is a writer too
    (10, "row_of", None, None, [("any", 0, 3)]), (11, "row_of", None, None, [("any", 0, 10)]),
    (20, "param_of", None, 1, [("any", 0, 21)]), (21, "instance_of", "Map", None, [("any", 0, 22), ("any", 0, 3)]), (22, "arg", None, 0, []),
    (30, "union", None, None, [("exact", 1, 22), ("any", 0, 31)]), (31, "union", None, None, [("at_most", 3, 2)]), (40, "receiver_or", "Class:Any", None, []),
]
CALLS = {
    "getter": (1, "Class:Foo", [], 0, "String"), "writer": (1, "Class:Foo", ["String"], 1, "Class:Foo"), "unknown number": (1, "Class:Foo", [], None, "String"), "no receiver": (1, None, ["x"], 1, None),
    "row": (10, "ResultSet<Base,Row>", [], 0, "Class:Row"), "no result set": (10, "Class:Foo", [], 0, None), "row of a row": (11, "ResultSet<Base,Row>", [], 0, None),
    "parameter": (20, "Class:Foo", ["Class:K"], 1, "Foo"), "argument missing": (20, "Class:Foo", [], 0, None), "instance": (21, "Class:Foo", ["Class:K"], 1, "Map<K,Foo>"),
    "nested union": (30, None, [], 3, "String"), "nested union, unknown": (30, None, [], None, None), "no branch": (30, None, [], 4, None), "exact": (30, None, ["Class:A"], 1, "Class:A"),
    "fallback": (40, None, [], 0, "Class:Any"), "receiver first": (40, "Class:B", [], 0, "Class:B"), "no such node": (99, "Class:B", [], 0, None),
}


def test_return_expressions(spark):
    calls = spark.createDataFrame([(k, root, r, a, n) for k, (root, r, a, n, _) in CALLS.items()], "id string, root long, receiver string, args array<string>, arity int")
    got = {r.id: r.type for r in R.evaluate(calls, nodes_of(spark, TREES)).collect()}
    assert got == {k: v[-1] for k, v in CALLS.items()}
    assert R.evaluate(calls.limit(0), nodes_of(spark, TREES)).count() == 0


def test_a_cycle_ends(spark):
    calls = spark.createDataFrame([(1, 1, None, [], 0)], "id int, root long, receiver string, args array<string>, arity int")
    assert [r.type for r in R.evaluate(calls, nodes_of(spark, [(1, "row_of", None, None, [("any", 0, 1)])])).collect()] == [None]


FIELDS = "att string, kind string, payload string, type string, observed string, priority int, seq long, start int, stop int, point int, fallback boolean"


def bag(kind, *rows, point=None):
    """Rows (type, priority, observed, (start, stop), payload, fallback), whose places are their order."""
    out = []
    for i, r in enumerate(rows):
        type_, priority, observed, span, payload, fallback = (*r, *(None, 10, None, (0, 0), None, False)[len(r) :])
        out.append((kind, payload or ("observation" if observed else "type"), type_, observed, priority, i, *span, point, fallback))
    return out


CASES = {
    "plugin before all": (bag("symbol", ("Class:A", 20), ("Class:B", 100), ("Class:C", 100), ("Class:D", 10)), ("Class:C", "plugin_override")),
    "deferred before values": (bag("symbol", ("Numeric",), ("Class:R", 10, None, (0, 0), "return_expr")), ("Class:R", "return_expr")),
    "deferred without an answer": (bag("package_symbol", ("Numeric",), (None, 20, None, (0, 0), "return_expr"), ("Class:R", 10, None, (0, 0), "return_expr")), ("Numeric", "package_symbol")),
    "deferred behind the point": (bag("variable", ("HashRef",), ("Class:R", 10, None, (9, 9), "return_expr"), point=5), ("HashRef", "framework")),
    "arms agree": (bag("return_arm", ("HashRef",), ("Hash{a}",)), ("HashRef", "return_arms")),
    "one arm": (bag("return_arm", ("Numeric",)), ("Numeric", "return_arms")),
    "an undef arm": (bag("return_arm", ("Numeric",), (None,)), ("Optional<Numeric>", "return_arms")),
    "arms disagree": (bag("return_arm", ("Numeric",), ("HashRef",)), None),
    "two classes in a slot": (bag("slot", ("Class:A",), ("Class:B",)), None),
    "one class in a slot": (bag("slot", ("Class:A",), ("HashRef",)), ("Class:A", "slot")),
    "a single branch": (bag("branch", ("Numeric",)), None),
    "branches agree": (bag("branch", ("Numeric",), ("Numeric",)), ("Numeric", "branch")),
    "a fallback branch": (bag("branch", ("Numeric",), ("String", 10, None, (0, 0), None, True)), ("String", "branch")),
    "narrowest region": (bag("variable", ("Class:A", 100), ("Class:B", 10, None, (0, 20)), ("Class:C", 10, None, (4, 6)), point=5), ("Class:C", "framework")),
    "later evidence": (bag("variable", ("Class:A", 10, None, (1, 1)), ("Class:B", 10, None, (8, 8)), point=5), ("Class:A", "framework")),
    "class by priority": (bag("variable", ("Class:A", 20), ("Class:B", 10)), ("Class:A", "framework")),
    "brand before class": (bag("variable", ("Brand:R", 10), ("Class:B", 20)), ("Brand:R", "framework")),
    "invocant before plain": (bag("variable", ("FirstParam:P",), ("HashRef",), ("Numeric",)), ("Class:P", "framework")),
    "structure stands": (bag("variable", ("Hash{a}",), ("HashRef",)), ("Hash{a}", "framework")),
    "structure is replaced": (bag("variable", ("Hash{a}",), ("Numeric",), ("HashRef",)), ("HashRef", "framework")),
    "use of a hash": (bag("variable", (None, 10, "numeric"), (None, 10, "hash_access")), ("HashRef", "framework")),
    "use of a pattern": (bag("variable", (None, 10, "string"), (None, 10, "regexp")), ("Regexp", "framework")),
    "latest of an expression": (bag("expr", ("Numeric",), ("String",)), ("String", "expr")),
    "latest of an alias": (bag("type_name", ("A",), ("B",)), ("B", "type_name")),
    "latest of a sub": (bag("symbol", ("Numeric",), ("String",)), ("String", "sub_return")),
    "a majority": (bag("domain", ("E",), ("E",), ("F",)), ("E", "domain")),
    "undef votes count": (bag("domain", ("E",), ("E",), (None,), (None,)), None),
    "a tie": (bag("domain", ("E",), ("F",)), None),
    "nothing known": (bag("expr", (None,)), None),
}


@pytest.fixture(scope="module")
def got(spark):
    rows = [(name, *r) for name, (b, _) in CASES.items() for r in b]
    return {r.att: (r.type, r.reducer) for r in R.reduced(spark.createDataFrame(rows, FIELDS)).collect()}


@pytest.mark.parametrize("name", CASES)
def test_ladder(got, name):
    assert got.get(name) == CASES[name][1]


def test_no_evidence(spark):
    assert R.reduced(spark.createDataFrame([], FIELDS)).count() == 0


def test_branches_without_a_number(spark):
    kids = spark.createDataFrame([([("empty", 0, 1), ("any", 0, 2)],), ([("empty", 0, 1)],), ([("exact", 3, 1)],), ([],)], "kids array<struct<guard:string,n:int,node:long>>")
    assert [[k.node for k in r.x] for r in kids.select(R.chosen(F.col("kids"), F.lit(None).cast("int")).alias("x")).collect()] == [[2], [1], [], []]
