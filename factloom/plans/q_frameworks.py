"""Routes, tasks and mapped columns over programs of frameworks, one for each supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.operators import frameworks as W
from factloom.operators.graph import cut
from factloom.operators.statements import statements
from factloom.plans.registry import register
from factloom.sources.code import filled
from factloom.sources.facts import table

#: {k}: the supplier; {n}: its nation; {q} and {e}: the quotes of its strings; {gap}: a blank or a line break.
APP = """package Shop::App{k};
use Mojo::Base 'Mojolicious';
sub startup {
    my $self = shift;
    my $r = $self->routes;
    $r->get({q}/{e})->to({q}home#index_{n}{e})->name({q}home_{k}{e});
    my $shop = $r->any({q}/shop{k}{e}){gap}->to(controller => {q}shop_{n}-item_list{e});
    my $admin = $shop->under({q}/admin{e})->to({q}auth#check{e});
    $shop->get({q}/:id{e}){gap}->to({q}#show_{k}{e});
    $admin->route({q}rest{e})->delete({q}/:id{e})->to(action => {q}drop{e});
    $other->get({q}/no{e})->to({q}no#no{e});
    # $r->get('/off')->to('off#off');
    $self->minion->add_task(pay_{n} => sub { my ($job) = @_; });
    $self->minion->enqueue({q}pay_{n}{e}, [{k}]);
}
package Shop::Result{k};
__PACKAGE__->add_columns({q}id{e},{gap}{q}size_{n}{e});
__PACKAGE__->add_columns(rank_{k} => { data_type => {q}integer{e}, extra => { list => [1, 2] } }, note => {});
__PACKAGE__->belongs_to(nation => {q}Shop::Nation{n}{e}, {q}nation_id{e});
"""


def _statements(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    way = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    text = filled(APP, q=way("'", '"', "q{"), e=way("'", '"', "}"), gap=way(" ", "\n        "), k=k, n=n)
    spread = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").repartition(spark.sparkContext.defaultParallelism, "s_suppkey")
    return statements(spread.select(k.cast("long").alias("file_id"), text.alias("text")))


@register("framework_routes", """WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS file_id, CAST(s_suppkey AS VARCHAR) AS k, CAST(s_nationkey AS VARCHAR) AS n FROM supplier)
SELECT file_id, 'Shop::App' || k AS package, x.method, x.path, x.controller, x.action, x.class, x.name FROM s, LATERAL (VALUES
 ('get', '/', 'home', 'index_' || n, 'Home', 'home_' || k), ('under', '/shop' || k || '/admin', 'auth', 'check', 'Auth', NULL),
 ('get', '/shop' || k || '/:id', 'shop_' || n || '-item_list', 'show_' || k, 'Shop' || n || '::ItemList', NULL),
 ('delete', '/shop' || k || '/admin/rest/:id', 'auth', 'drop', 'Auth', NULL)) x(method, path, controller, action, class, name)""")
def framework_routes(spark: SparkSession, d: str) -> DataFrame:
    """Every route with its path and target, from chains upon chains."""
    return W.routes(_statements(spark, d)).drop("line")


@register("framework_members", """WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS file_id, CAST(s_suppkey AS VARCHAR) AS k, CAST(s_nationkey AS VARCHAR) AS n FROM supplier)
SELECT file_id, x.* FROM s, LATERAL (VALUES ('column', 'id', NULL), ('column', 'size_' || n, NULL), ('column', 'rank_' || k, NULL), ('column', 'note', NULL),
 ('belongs_to', 'nation', 'Shop::Nation' || n), ('task', 'pay_' || n, NULL), ('enqueue', 'pay_' || n, NULL)) x(kind, name, class)""")
def framework_members(spark: SparkSession, d: str) -> DataFrame:
    """Columns and relations that become accessors, and tasks with where they are put into the queue."""
    rows = cut(_statements(spark, d))
    return W.mapped(rows).select("file_id", "kind", "name", "class").unionByName(W.tasks(rows).select("file_id", "kind", "name", F.lit(None).cast("string").alias("class")))
