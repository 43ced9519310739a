"""Source text over the driver's tables: a small program for each customer and nation, and units of other languages for each supplier.

The text is a function of the row, so that an oracle can state from the columns what an extraction has to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factloom.sources.facts import table

#: Customers whose program is nested too deeply to be analysed: c_custkey % DEEP_EVERY = DEEP_REST.
DEEP_EVERY, DEEP_REST, NESTING = 50, 7, 100

#: Spellings of one construct, by row; each takes as many lines as the others.
SPELLINGS = {
    "root": ("'lib/n{n}'", '"lib/n{n}"', "qw(lib/n{n})", "q{lib/n{n}}"),
    "parent": ("use parent -norequire, 'Shop::N{n}';", 'use parent -norequire => "Shop::N{n}";', "use parent qw(-norequire Shop::N{n});", "use parent (q{-norequire}, 'Shop::N{n}');"),
    "imports": ("use Shop::Util qw(load_{n} save_{n});\nuse constant LIMIT => {k};", "use Shop::Util ('load_{n}',\n  \"save_{n}\"); use constant LIMIT => {k};", "use Shop::Util qw/load_{n}\nsave_{n}/; use constant LIMIT => {k};"),
    "attributes": ("has 'color_{n}' => (is => 'rw', isa => 'Str');\nhas owner => (is => 'ro', isa => 'Shop::N{n}', predicate => 1);", "has \"color_{n}\" => (is => \"rw\", # shown\n  isa => q(Str)); has 'owner' => (is => 'ro', isa => \"InstanceOf['Shop::N{n}']\", predicate => 1);"),
}
#: {k}: key of the customer; {n}: its nation; {pragma}, {deep}, {break} and the spellings vary by row.
CUSTOMER = """package Shop::C{k};
use {pragma};
use lib {root};
{parent}
{imports}
our @EXPORT_OK = qw(run_{k}{break}stop_{n});
our %EXPORT_TAGS = (all => [qw(run_{k} stop_{n})], ctl => [qw(stop_{n})]);
{attributes}
# Makes one.
# It has a rank of {n}.
sub new {
    my ($class, %args) = @_;
    my $self = bless { name => $args{name}, rank => {n} }, $class;
    return $self;
}
sub run_{k} {
    my ($self, $x, $y) = @_;
    if (@_ == 1) { return 'none'; }
    if (@_ == 2) { return 42; }
    my $total = $x;
    my $copy = $total;
    load_{n}($copy, 7);
    $self->stop_{n}($total);
    return [] unless defined $y;
    if (ref $x eq 'HASH') {
        print $x->{seen};
        $x = 1;
        print $x;
    }
    Shop::Util::log_{n}("run {k}");
    my $obj = Shop::C{k}->new;
    my $who = $obj->owner->boss;
    if ($who->isa('Shop::R')) {
        $who->pay({k}, "a,b", [1, 2], $y);
    }
    $self->{seen_{n}} = 1;
    $self->on('event_{n}');
    mystery_{k}({deep});
    return { total => $total };
}
sub stop_{n} { my ($self) = @_; return $self->{rank}; }
1;
__END__
sub auto_{k} {
}
"""
NATION = """package Shop::N{n};
has boss => (is => 'ro', isa => 'Shop::C{n}');
sub base_{n} {
    my ($self) = @_;
    return $self->{size};
}
1;
"""
#: Of each supplier ({k}, {n}), by language.
UNITS = {
    "python": "import os_{n}\nclass S{k}(Base{n}):\n    def run_{k}(self, a):\n        return helper_{n}(a)\n",
    "cpp": '#include "n{n}.h"\nnamespace shop {\nclass S{k} : public Base{n} {\npublic:\n  int run_{k}(int a);\nprivate:\n  int rank_{n};\n};\n}\n',
    "r": "library(n{n})\nrun_{k} <- function(a) {\n  helper_{n}(a)\n}\n",
    "cmake": "find_package(N{n})\nadd_library(s{k} a.c)\ntarget_link_libraries(s{k} n{n})\n",
}


#: Accesses to members, of each supplier.
ACCESSES = """void f{k}() {
  Base{n} v;
  Base{n} *p;
  Base{n} **q = all;
  const Base{n} &r = v;
  v.rank = v->rank;
  p.run(); p->run();
  q->run(r.rank, r->rank);
  Base{n} p;
  p->run();
}
"""


def filled(template: str | Column, **values: Column) -> Column:
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def programs(spark: SparkSession, d: str) -> DataFrame:
    """file_id, path, text of every customer's program, and of every nation's under a negative file_id."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    deep = F.when(k % DEEP_EVERY == DEEP_REST, F.lit("{" * NESTING + "}" * NESTING)).otherwise("")
    spelt = {name: F.element_at(F.array(*map(F.lit, ways)), (k % len(ways) + 1).cast("int")) for name, ways in SPELLINGS.items()}
    text = filled(CUSTOMER, **spelt)
    text = F.replace(text, F.lit("{break}"), F.when(k % 2 == 0, " ").otherwise("\n"))
    text = F.when(k % 2 == 0, text).otherwise(F.replace(text, F.lit(");\nour %EXPORT_TAGS"), F.lit("); our %EXPORT_TAGS")))
    text = filled(text, k=k, n=n, pragma=F.when(k % 3 == 0, "AutoLoader").otherwise("strict"), deep=deep)
    spread = table(spark, d, "customer").select("c_custkey", "c_nationkey").repartition(spark.sparkContext.defaultParallelism, "c_custkey")  # two numbers a row, before they become a text
    own = spread.select(k.alias("file_id"), F.concat(F.lit("lib/Shop/C"), k.cast("string"), F.lit(".pm")).alias("path"), text.alias("text"))
    n = F.col("n_nationkey")
    base = table(spark, d, "nation").select((-1 - n).cast("long").alias("file_id"), F.concat(F.lit("lib/Shop/N"), n.cast("string"), F.lit(".pm")).alias("path"), filled(NATION, n=n).alias("text"))
    return own.unionByName(base)


def units(spark: SparkSession, d: str) -> DataFrame:
    """file_id, lang, text: the units of every supplier."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("lang"), filled(t, k=k, n=n).alias("text")) for x, t in UNITS.items()])).alias("x")
    return table(spark, d, "supplier").select(k.cast("long").alias("file_id"), each).select("file_id", "x.lang", "x.text")


def accesses(spark: SparkSession, d: str) -> DataFrame:
    """file_id, text: a function of every supplier that uses members."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("file_id"), filled(ACCESSES, k=F.col("s_suppkey"), n=F.col("s_nationkey")).alias("text"))
