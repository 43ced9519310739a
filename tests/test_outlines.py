"""Nested outlines, selection ranges and hints on a program written by hand."""

import pytest

from factloom.operators import extract as X, outlines as O

TEXT = """package A;
our $top = 1;
sub one {
    my ($self, $x) = @_;
    if ($x) {
        for my $i (1 .. 3) { my $deep = $i; go($i, [1, 2], x => 1) }
        two($self,
            f(1, 2), $y);
    }
    return sub { my $inner = 1; $inner };
}
sub two { my ($self, $first, $y) = @_; 1 }
package B {
    my %h = (a => { b => 1 });
    sub three($p) {
        three(4);
    }
}
"""


@pytest.fixture(scope="module")
def rows(spark):
    return X.scoped(X.statements(spark.createDataFrame([(1, TEXT), (2, ""), (3, "sub open_ended {\n  my $z = 1;\n")], "file_id long, text string"))).cache()


def test_outline(rows):
    got = sorted((r.file_id, r.line, r.kind, r.name, r.end_line, r.level, "/".join(r.path)) for r in O.outline(rows).collect())
    assert got == sorted([
        (1, 0, "package", "A", 0, 0, "A"), (1, 1, "variable", "$top", 1, 1, "A/$top"), (1, 2, "sub", "one", 10, 1, "A/one"), (1, 3, "variable", "$self", 3, 2, "A/one/$self"), (1, 3, "variable", "$x", 3, 2, "A/one/$x"),
        (1, 5, "variable", "$deep", 5, 2, "A/one/$deep"), (1, 9, "variable", "$inner", 9, 2, "A/one/$inner"), (1, 11, "sub", "two", 11, 1, "A/two"), (1, 11, "variable", "$self", 11, 2, "A/two/$self"), (1, 11, "variable", "$first", 11, 2, "A/two/$first"), (1, 11, "variable", "$y", 11, 2, "A/two/$y"),
        (1, 12, "package", "B", 17, 0, "B"), (1, 13, "variable", "%h", 13, 1, "B/%h"), (1, 14, "sub", "three", 16, 1, "B/three"), (3, 0, "sub", "open_ended", 1, 0, "open_ended"), (3, 1, "variable", "$z", 1, 1, "open_ended/$z"),
    ])


def test_blocks_know_what_is_around(rows):
    found = {(r.start_line, r.end_line): r for r in O.blocks(rows).where("file_id = 1").collect()}
    line_of = {r.block: r.start_line for r in found.values()}
    assert {k: line_of.get(r.parent) for k, r in found.items()} == {(2, 10): None, (4, 8): 2, (5, 5): 4, (9, 9): 2, (11, 11): None, (12, 17): None, (14, 16): 12}


def test_selection_ranges(spark, rows):
    points = spark.createDataFrame([(1, 7), (1, 15), (1, 1), (3, 1), (1, 99)], "file_id long, line int")
    got = sorted(tuple(r) for r in O.selection_ranges(rows, points).select("file_id", "line", "level", "start_line", "end_line").collect())
    assert got == [(1, 1, 0, 1, 1), (1, 7, 0, 6, 7), (1, 7, 1, 4, 8), (1, 7, 2, 2, 10), (1, 15, 0, 15, 15), (1, 15, 1, 14, 16), (1, 15, 2, 12, 17), (3, 1, 0, 1, 1), (3, 1, 1, 0, 1)]


def test_hints(rows):
    got = sorted((r.line, r.name, r.slot, r.param, r.argument) for r in O.parameter_hints(rows).collect())
    assert got == [(6, "two", 1, "$first", "f(1, 2)"), (15, "three", 0, "$p", "4")]
