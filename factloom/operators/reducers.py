"""Deferred return types, and the whole ladder of reducers over a bag of evidence.

A return expression is a tree kept as rows, so that a sub's declared policy is data: what it returns may be the receiver,
an argument, a row of the receiver's result set, a type parameter, a template's instance, or one of several by the number
of arguments. ``evaluate`` answers many calls at once: each round joins the open nodes of all calls with the table of nodes
and picks the children that the call's arguments choose; the values then travel back up level by level, a group a node.

``reduced`` folds evidence into a type per attachment: each reducer is a set of aggregates that combine before the shuffle,
and the first in their order that answers wins. Attachments are of one kind, which decides what reducers claim them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions import types as T
from factloom.operators.evidence import DEFAULT_PRIORITY, arity_guard, branch_arms, is_class, latest, majority, return_arms, slot
from factloom.operators.graph import dealt, kept

#: Nodes of return expressions: op is concrete (type), receiver, receiver_or (type), arg (i), row_of, param_of (i), instance_of (type), union.
NODES = "node long, op string, type string, i int, kids array<struct<guard:string,n:int,node:long>>"
#: Levels of a return expression; deeper ones have no value.
MAX_LEVELS = 32
#: Kinds of attachments on which a return expression is claimed.
DEFERRED_ON = ("symbol", "package_symbol", "expr", "variable")


def result_set(base: Column | str, row: Column | str) -> Column:
    """The type of a set of rows: a template of its own, so that it has a row class."""
    return F.concat(F.lit("ResultSet<"), base, F.lit(","), row, F.lit(">"))


def row_class(t: Column) -> Column:
    """The class of a result set's rows; null for any other type."""
    return F.when(T.template_base(t) == "ResultSet", F.concat(F.lit("Class:"), F.get(T.template_arguments(t), F.lit(1))))


def chosen(kids: Column, arity: Column) -> Column:
    """The one branch that a call takes: the first whose guard holds; without a known number the one for any, else the empty one."""
    holds = F.filter(kids, lambda k: arity_guard(k["guard"], k["n"], arity))
    of = lambda guard: F.filter(kids, lambda k: k["guard"] == guard)
    return F.slice(F.when(arity.isNotNull(), holds).when(F.size(of("any")) > 0, of("any")).otherwise(of("empty")), 1, 1)


def evaluate(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, type (null where nothing answers) for each of calls (id, root, receiver, args, arity): the value of its return expression.

    Repeated ids are calls of their own. Rounds are as many as the deepest expression has levels (MAX_LEVELS at most); the kids of a node meet in one group.
    """
    calls = kept(calls.withColumn("call", F.monotonically_increasing_id()))
    front = calls.select("call", F.array().cast("array<int>").alias("path"), F.col("root").alias("node"), "receiver", "args", "arity")
    levels = []
    for _ in range(MAX_LEVELS):
        met = front.join(dealt(nodes), "node", "left")
        own = F.when(F.col("op") == "concrete", F.col("type")).when(F.col("op") == "receiver", F.col("receiver")).when(F.col("op") == "receiver_or", F.coalesce("receiver", "type")).when(F.col("op") == "arg", F.get("args", F.col("i")))
        kids = F.when(F.col("op") == "union", chosen(F.col("kids"), F.col("arity"))).when(F.col("op").isin("row_of", "param_of", "instance_of"), F.col("kids"))
        met = kept(met.withColumn("own", own).withColumn("taken", F.coalesce(kids, F.array().cast("array<struct<guard:string,n:int,node:long>>"))))
        levels.append(met.select("call", "path", "op", "type", "i", "own", F.size("taken").alias("n")))
        front = met.select("call", F.posexplode("taken").alias("at", "kid"), "path", "receiver", "args", "arity").select("call", F.concat("path", F.array(F.col("at").cast("int"))).alias("path"), F.col("kid.node").alias("node"), "receiver", "args", "arity")
        if front.isEmpty():
            break
    below = None
    for level in reversed(levels):
        if below is None:
            below = level.select("call", "path", F.when(F.col("n") == 0, F.col("own")).alias("value"))
            continue
        inner = below.groupBy("call", F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).agg(F.array_sort(F.collect_list(F.struct(F.element_at("path", -1).alias("at"), "value"))).alias("x"))
        joined = level.join(dealt(inner.withColumn("values", F.transform("x", lambda v: v["value"])).drop("x")), ["call", "path"], "left")
        one = F.get("values", F.lit(0))
        whole = (F.size("values") == F.col("n")) & F.forall("values", lambda v: v.isNotNull())
        made = F.when(whole, F.concat(F.col("type"), F.lit("<"), F.array_join(F.transform("values", lambda v: F.regexp_replace(v, "^Class:", "")), ","), F.lit(">")))
        parameter = F.get(T.template_arguments(one), F.col("i"))
        value = F.when(F.col("op") == "union", one).when(F.col("op") == "row_of", row_class(one)).when((F.col("op") == "param_of") & (T.template_base(one) != "ResultSet"), parameter).when(F.col("op") == "instance_of", made).otherwise(F.col("own"))
        below = joined.select("call", "path", value.alias("value"))
    return calls.select("id", "call").join(dealt(below), "call").select("id", F.col("value").alias("type"))


def assignment(t: Column, priority: Column, seq: Column) -> Column:
    """The plain type of a variable: the highest priority, then the last one, unless that is the bare reference of a structure which stands."""
    by = F.struct(priority.alias("p"), seq.alias("s"))
    last, best = F.max_by(t, F.when(t.isNotNull(), by)), F.max(F.when(t.isNotNull(), by))
    out = last
    for bare, whole in (("HashRef", "Hash{"), ("ArrayRef", "Sequence(")):
        other = t.isNotNull() & (t != bare)
        standing, at = F.max_by(t, F.when(other, by)), F.max(F.when(other, by))
        out = F.when((last == bare) & standing.startswith(whole) & (at["p"] == best["p"]), standing).otherwise(out)
    return out


#: What an observation of use says of a representation.
REPRESENTATION = {"hash_access": "HashRef", "array_access": "ArrayRef", "code_call": "CodeRef"}


def framework_aware() -> Column:
    """A variable's type at a point: the narrowest region that holds it; else its brand, its class, the invocant's class, a plain type, or how it is used."""
    c = F.col
    typed, seen = c("payload") == "type", c("payload") == "observation"
    spanned = c("stop") > c("start")
    holds = c("point").isNotNull() & c("point").between(c("start"), c("stop"))
    at_point = (c("kind") == "variable") & c("point").isNotNull()
    narrow = F.min_by("type", F.when(at_point & typed & spanned & holds, F.struct((c("stop") - c("start")).alias("size"), "seq")))
    alive = ~at_point | (c("start") <= c("point")) & (~typed | ~spanned | holds)
    by = F.struct("priority", "seq")
    of = lambda cond, order=by: F.max_by("type", F.when(alive & cond, order))
    brand = of(typed & c("type").startswith("Brand:"), c("seq"))
    asserted = of(typed & is_class(c("type")) | seen & (c("observed") == "class"))
    first = of(typed & c("type").startswith("FirstParam:") | seen & (c("observed") == "first_param"), c("seq"))
    other = typed & alive & ~is_class(c("type")) & ~c("type").startswith("Brand:") & ~c("type").startswith("FirstParam:")
    plain = assignment(F.when(other, c("type")), c("priority"), c("seq"))
    named = F.coalesce(*[F.when(c("observed") == k, v) for k, v in REPRESENTATION.items()])
    used = F.max_by(named, F.when(alive & seen & named.isNotNull(), c("seq")))
    blessed = of(seen & (c("observed") == "bless"), c("seq"))
    flag = lambda kind, t: F.when(F.bool_or(alive & seen & (c("observed") == kind)), t)
    as_class = F.when(first.isNotNull(), F.concat(F.lit("Class:"), F.regexp_replace(first, "^(FirstParam|Class):", "")))
    return F.coalesce(narrow, brand, asserted, as_class, plain, used, blessed, flag("regexp", "Regexp"), flag("numeric", "Numeric"), flag("string", "String"))


def reduced(rows: DataFrame) -> DataFrame:
    """att, type, reducer of evidence: the eleven reducers in their order, the first that answers wins.

    rows: att; kind of the attachment (symbol, package_symbol, expr, expression, variable, return_arm, slot, branch,
    type_name, domain); payload (type, observation, return_expr); type (null for an undef arm; of a return_expr what it
    evaluates to for the question asked); observed (what kind of use); priority; seq; start and stop (where the evidence
    holds; equal ones everywhere from there); point (of the question, or null); fallback (of a branch).
    """
    c, t, seq = F.col, F.when(F.col("payload") == "type", F.col("type")), F.col("seq")
    kind, typed = F.min("kind"), F.col("payload") == "type"
    on = lambda kinds, x: F.when(kind.isin(*kinds), x)
    deferred = (c("payload") == "return_expr") & ((c("kind") != "variable") | c("point").isNull() | (c("start") <= c("point")))
    plugin = F.max_by("type", F.when(typed & c("type").isNotNull() & (c("priority") > DEFAULT_PRIORITY), F.struct("priority", "seq")))
    ladder = {
        "plugin_override": on(("symbol",), plugin),
        "return_expr": on(DEFERRED_ON, F.max_by(F.struct("type"), F.when(deferred, F.struct("priority", "seq")))["type"]),
        "return_arms": on(("return_arm",), return_arms(t, seq)),
        "slot": on(("slot",), slot(t, seq)),
        "branch": on(("branch",), branch_arms(t, seq, c("fallback"))),
        "framework": on(("variable", "expression"), framework_aware()),
        "expr": on(("expr",), latest(t, seq)),
        "package_symbol": on(("package_symbol",), latest(t, seq)),
        "type_name": on(("type_name",), latest(t, seq)),
        "sub_return": on(("symbol",), latest(t, seq)),
    }
    out = rows.where("kind <> 'domain'").groupBy("att").agg(*[x.alias(name) for name, x in ladder.items()])
    first = F.coalesce(*[F.when(c(name).isNotNull(), F.struct(c(name).alias("type"), F.lit(name).alias("reducer"))) for name in ladder])
    found = out.select("att", first.alias("x")).select("att", "x.*").where("type is not null")
    votes = majority(rows.where("kind = 'domain'"), ["att"], "type").select("att", F.col("winner").alias("type"), F.lit("domain").alias("reducer"))
    return found.unionByName(votes)
