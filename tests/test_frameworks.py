"""Routes, tasks and mapped columns on programs written by hand."""

from factloom.operators import frameworks as W
from factloom.operators.statements import statements

APP = """package My::App;
use Mojo::Base 'Mojolicious';
sub startup {
    my $self = shift;
    my $r = $self->routes;
    $r->get('/')->to('example#welcome')->name('home');
    my $users = $r->any('/users')->to(controller => 'sales-user_list');
    $users->get("/:id")
          ->to('#show')->name(q{user});
    $users->any([qw(GET POST)] => 'edit')->to(action => 'edit');
    my $admin = $users->under('/admin')->to('auth#check');
    my $deep = $admin->route('/deep');
    $deep->delete('/x')->to('#drop');
    $r = $r->under('/v2');
    $r->post('/n')->to('Api::Note#make');
    $r->get('/none');
    $self->routes->get('/direct')->to('a#b');
    $other->get('/no')->to('x#y');
    $r->get('/half')->to('#alone');
    # $r->get('/off')->to('off#off');
}
sub other { my $c = shift; $users->get('/far')->to('#far'); $c->to('p#q'); }
1;
"""


def _rows(spark, *texts):
    return statements(spark.createDataFrame(list(enumerate(texts)), "file_id long, text string"))


def test_routes(spark):
    got = {(r.method, r.path, r.controller, r.action, r["class"], r.name) for r in W.routes(_rows(spark, APP, "", None)).collect()}
    assert got == {
        ("get", "/", "example", "welcome", "Example", "home"),
        ("get", "/users/:id", "sales-user_list", "show", "Sales::UserList", "user"),
        ("any", "/users/edit", "sales-user_list", "edit", "Sales::UserList", None),
        ("under", "/users/admin", "auth", "check", "Auth", None),
        ("delete", "/users/admin/deep/x", "auth", "drop", "Auth", None),
        ("post", "/v2/n", "Api::Note", "make", "Api::Note", None),
        ("get", "/direct", "a", "b", "A", None),
    }


def test_bases_of_any_depth(spark):
    n = 40
    chain = "".join(f"my $r{k + 1} = $r{k}->any('/p{k}');\n" for k in range(n))
    text = f"my $r0 = $app->routes->to(controller => 'c');\n{chain}$r{n}->get('/end')->to('#a');\n"
    rows = W.routes(_rows(spark, text)).where("action = 'a'").collect()
    assert [r.path for r in rows] == ["".join(f"/p{k}" for k in range(n)) + "/end"] and rows[0].controller == "c"


def test_tasks(spark):
    text = """$app->minion->add_task(resize => sub {
    my ($job, @args) = @_;
});
$minion->add_task('mail.send', \\&send);
$c->minion->enqueue('resize', [1], {priority => 3}); $self->minion->enqueue("mail.send");
my $s = "->enqueue('no')";
"""
    got = [(r.line, r.kind, r.name) for r in W.tasks(_rows(spark, text)).orderBy("line", "name").collect()]
    assert [g[1:] for g in got] == [("task", "resize"), ("task", "mail.send"), ("enqueue", "mail.send"), ("enqueue", "resize")]


def test_mapped(spark):
    text = """package My::Schema::Result::Item;
use base 'DBIx::Class::Core';
__PACKAGE__->table('item');
__PACKAGE__->add_columns(qw(id name), 'size');
__PACKAGE__->add_columns(
    owner_id => { data_type => 'integer', extra => { list => { a => 1 } } },
    "note"   => { data_type => 'text', is_nullable => 1 },
);
__PACKAGE__->add_column('+late' => { x => 1 });
__PACKAGE__->belongs_to(owner => 'My::Schema::Result::User', 'owner_id');
__PACKAGE__->has_many('parts', "My::Schema::Result::Part", { 'foreign.item' => 'self.id' });
"""
    got = {(r.kind, r.name, r["class"]) for r in W.mapped(_rows(spark, text)).where("package = 'My::Schema::Result::Item'").collect()}
    assert got == {("column", n, None) for n in ("id", "name", "size", "owner_id", "note", "late")} | {("belongs_to", "owner", "My::Schema::Result::User"), ("has_many", "parts", "My::Schema::Result::Part")}
