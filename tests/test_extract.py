"""The extract stage on programs written by hand: what lines, scopes, guards and braces do at their edges."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import extension, types as T
from factloom.operators import extract as X, navigate as N, spans as S, store as ST
from factloom.operators.statements import Reader

PROGRAM = """use Carp;
package A;
our @EXPORT = qw(one);
push @EXPORT, qw(two three);
has name => (is => 'rw', isa => 'Str', clearer => 'wipe', predicate => 'named');
sub one {
    my ($self, $x, $y) = @_;
    my $text = "}{ sub no { my $z";  # sub neither {
    if (defined $x) {
        if ($y->isa('B')) {
            $y->go($x, f(1, 2), [3, 4], "a,b");
        }
        $y->stay;
    }
    foreach my $i (1, 2) {
        $x->{key} = $i;
    }
    return $text unless ref($x) eq 'HASH';
    $x = undef;
    die;
}
package B;
sub new { my $class = shift; my $self = bless {}, 'B::Impl'; return $self }
sub go { my ($self) = @_; return -1.5; }
__DATA__
package C;
sub hidden { }
"""


@pytest.fixture(scope="module")
def rows(spark):
    sources = spark.createDataFrame([(1, PROGRAM), (2, ""), (3, None), (4, "no code at all")], "file_id long, text string")
    return X.scoped(X.statements(sources)).cache()


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_scopes(rows):
    assert values(X.declarations(rows).where("kind in ('package', 'sub', 'loop')"), "kind", "name", "package", "sub") == sorted(
        [("package", "A", "A", None), ("package", "B", "B", None), ("sub", "one", "A", "one"), ("sub", "new", "B", "new"), ("sub", "go", "B", "go"), ("loop", "$i", "A", "one")], key=str
    )
    assert rows.where("line = 0").select("package").distinct().collect()[0].package == "main"
    assert values(rows.where("file_id = 1 and sub = 'one'").agg(F.min("line"), F.max("line")), "*") == [(5, 20)]


def test_braces_in_strings_and_comments(rows):
    assert values(N.folding_ranges(rows), "start_line", "end_line") == [(14, 16), (5, 20), (8, 13), (9, 11)]


def test_narrowing_ends_with_its_block_or_a_binding(rows):
    assert values(X.narrowings(rows), "var", "type", "from_line", "to_line") == [("$x", "Defined", 9, 12), ("$y", "B", 10, 10)]


def test_exports_and_accessors(rows):
    assert values(X.exports(rows), "tag", "name", "always") == sorted([(None, "one", True), (None, "three", True), (None, "two", True)], key=str)
    assert values(X.accessors(rows), "name", "role") == [("name", "accessor"), ("named", "predicate"), ("wipe", "clearer")]


def test_bless_and_returns(rows):
    assert values(X.blessed(rows), "var", "class") == [("$self", "B::Impl")]
    assert values(X.arity_returns(rows), "sub", "arity", "type") == [("go", None, "Num")]


def test_chains_of_several_steps(spark):
    text = "package P{i};\nhas next => (is => 'ro', isa => 'P{j}');\nsub run {\n    my ($self) = @_;\n    my $far = $self->next->next->next;\n    $far->next;\n    $self->none->next;\n}\n"
    sources = spark.createDataFrame([(i, text.replace("{i}", str(i)).replace("{j}", str(i + 1))) for i in range(6)], "file_id long, text string")
    r = X.scoped(X.statements(sources))
    got = {(x.file_id, x.line): x.type for x in N.typed_chains(r).collect()}
    assert all(got[i, 4] == (f"P{i + 3}" if i < 4 else None) and got[i, 6] is None for i in range(6))
    assert {(x.file_id, x.type) for x in N.type_at(r).where("line = 5").collect()} == {(i, f"P{i + 3}") for i in range(4)}


def test_too_deep(spark):
    sources = spark.createDataFrame([(1, "sub a {\n" + "{" * 40 + "}" * 40 + "\n}\n"), (2, "sub b {\n}\n")], "file_id long, text string")
    nested = X.statements(sources)
    assert [tuple(r) for r in X.too_deep(nested, 20).select("file_id", "depth").collect()] == [(1, 41)]
    assert values(X.declarations(X.scoped(nested, 20)), "name") == [("b",)]


def test_argument_slot_at_any_depth(spark):
    cases = {"": 0, "a": 0, "a, b": 1, "(1, 2), 3": 1, "((((((1, 2), 3), 4), 5), 6), 7), 8, 9": 2, '"x,y", 2': 1, "f(1, g(2, ": 0, "), 1": 1}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.n for r in df.select("t", extension.argument_slot(F.col("t")).alias("n")).collect()} == cases


def test_templates(spark):
    df = spark.createDataFrame([("std::map < int , Foo< A<B>, C > >",), ("Plain",), ("unsigned  int",), ("F<T, T>",)], "t string")
    of = F.create_map(F.lit("T"), F.lit("U"), F.lit("U"), F.lit("T"))
    got = [tuple(r) for r in df.select(T.canonical(F.col("t")), T.template_base(F.col("t")), T.template_arguments(F.col("t")), T.substituted(F.col("t"), of)).collect()]
    assert got == [("std::map<int,Foo<A<B>,C>>", "std::map", ["int", "Foo<A<B>,C>"], "std::map<int,Foo<A<B>,C>>"), ("Plain", "Plain", [], "Plain"), ("unsigned int", "unsigned int", [], "unsigned int"), ("F<T,T>", "F", ["T", "T"], "F<U,U>")]


def test_contained_left_keeps_points(spark):
    points = spark.createDataFrame([("a", 5), ("a", 50), ("b", 1)], "k string, pos long")
    intervals = spark.createDataFrame([("a", 0, 10, "x"), ("a", 6, 9, "y")], "k string, start long, end long, v string")
    assert values(S.contained(points, intervals, ["k"], 8, "left"), "k", "pos", "v") == [("a", 5, "x"), ("a", 50, None), ("b", 1, None)]


def test_generations(spark, tmp_path):
    path = str(tmp_path / "g")
    assert ST.current(spark, path) is None
    ST.publish(spark.range(3).toDF("id"), path, 1)
    ST.write_generation(spark.range(9).toDF("id"), path, 2)
    assert ST.current(spark, path) == 1 and ST.published(spark, path).count() == 3


SPELLINGS = '''package My::Thing;
use parent qw(Foo
    Bar);
use base "Old";
extends 'Base';
with 'RoleX', "RoleY" => { -alias => { a => 'b' } };
push @ISA, 'Late';
our @EXPORT_OK = qw(
    one two
);
our %EXPORT_TAGS = (
    all => [qw(one two)],
    'some' => ["one"],
);
has "size" => (
    is => "rw",
    isa => 'Int',    # a comment, with (signs
    predicate => 'has_size',
);
has [qw(a b)] => (is => 'ro');
has secret => (is => 'bare');
has state => (is => 'rwp', clearer => 1);
__PACKAGE__->mk_accessors(qw(left right));

=head1 DOC

sub in_pod { }

=cut

use constant { ONE => 1, LIST => [1, 2] };
sub g($x, $y = {}, @rest) {
    Bar->baz(1);
    My::Other->make(s => 1)->run;
    $x
        ->first
        ->second;
    helper ($x); __PACKAGE__->own;
    if ($x) { if ($y) { if (@rest) { if (1) { deep(1) } } } }
    return $x{s}{y} =~ m{a{2}} ? "}" : q(});
}
*alias = \\&g;
my $text = <<"EOT" . <<~'END';
sub in_heredoc { $x }
EOT
    sub in_other { }
    END
package Block { sub inner { my $self = shift; return $self } }
sub after { AUTOLOAD_not(1) }
'''


@pytest.fixture(scope="module")
def spelt(spark):
    return X.scoped(X.statements(spark.createDataFrame([(1, SPELLINGS)], "file_id long, text string"))).cache()


def test_parents_in_any_spelling(spelt):
    assert values(X.inherits(spelt), "src", "dst") == [("My::Thing", x) for x in ("Bar", "Base", "Foo", "Late", "Old", "RoleX", "RoleY")]


def test_exports_over_lines(spelt):
    assert values(X.exports(spelt), "tag", "name") == sorted([(None, "one"), (None, "two"), ("all", "one"), ("all", "two"), ("some", "one")], key=str)


def test_accessors_in_any_spelling(spelt):
    got = values(X.accessors(spelt), "line", "name", "role", "type")
    assert got == sorted([(14, "size", "accessor", "Int"), (14, "has_size", "predicate", None), (19, "a", "getter", None), (19, "b", "getter", None), (21, "state", "getter", None), (21, "_set_state", "writer", None), (21, "clear_state", "clearer", None), (22, "left", "accessor", None), (22, "right", "accessor", None)], key=str)


def test_calls_and_receivers(spelt):
    got = values(X.calls(spelt), "line", "kind", "receiver", "name")
    assert got == sorted([(22, "method", "My::Thing", "mk_accessors"), (32, "method", "Bar", "baz"), (33, "method", "My::Other", "make"), (34, "method", "$x", "first"), (37, "function", None, "helper"), (37, "method", "My::Thing", "own"), (38, "function", None, "deep"), (48, "function", None, "AUTOLOAD_not")], key=str)
    assert values(X.chains(spelt), "line", "chain") == [(32, "Bar->baz"), (33, "My::Other->make"), (34, "$x->first->second")]


def test_declarations_leave_out_documentation_and_text(spelt):
    got = values(X.declarations(spelt).where("kind in ('sub', 'glob', 'package', 'parameter')"), "kind", "name", "package", "sub")
    assert got == sorted(
        [("package", "My::Thing", "My::Thing", None), ("sub", "g", "My::Thing", "g"), ("parameter", "$x", "My::Thing", "g"), ("parameter", "$y", "My::Thing", "g"), ("parameter", "@rest", "My::Thing", "g"),
         ("glob", "alias", "My::Thing", None), ("package", "Block", "Block", None), ("sub", "inner", "Block", "inner"), ("sub", "after", "My::Thing", "after")], key=str
    )
    assert values(X.parameters(spelt), "sub", "params") == [("g", ["$x", "$y", "@rest"])]
    assert values(X.uses(spelt).where("kind = 'constant'"), "name", "value") == [("LIST", "[1, 2]"), ("ONE", "1")]


def test_nested_blocks_of_one_line(spelt):
    deep = spelt.where("line = 38").orderBy("at").collect()
    assert [(r.norm, r.depth, r.ends) for r in deep] == [("if ($x) {", 1, 0), ("if ($y) {", 2, 0), ("if (@rest) {", 3, 0), ("if (1) {", 4, 0), ("deep(1)", 5, 0), ("}", 5, 1), ("}", 4, 1), ("}", 3, 1), ("}", 2, 1)]


@pytest.mark.parametrize("text", ["", "}", ")]}", "sub {", "'never", "s/a", "qw(", "=pod\n", "<<EOT\nx", "{" * 30, "$", "@", "__END__", "a ? b : c", "x" * 5000, "\x00\xff", "L: for (;;) { next L }"])
def test_any_text_is_read(text):
    rows = Reader(text).read()
    assert [r["at"] for r in rows] == list(range(len(rows))) and all(r["line"] <= r["end_line"] for r in rows)
