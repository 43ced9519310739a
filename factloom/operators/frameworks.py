"""What frameworks make of ordinary calls: routes of a web framework, tasks of a job queue, columns and relations of an object mapper.

A route is a chain of calls: each verb adds to the path, ``to`` sets where it leads, and a chain that starts at a variable goes
on from the chain that was last assigned to it in that sub. One chain is a fold over its calls within its statement; chains on
chains are joined by doubling, as a base of a base is a base again. Only chains that start at ``routes`` are routes.

rows are statements (``statements``). Defined results: an action without a controller anywhere along its bases gives no row,
as does a controller without an action; a variable that was never assigned leads nowhere; a handler given as a block is no target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factloom.operators import spans as S
from factloom.operators.extract import every, got, live
from factloom.operators.graph import cut

#: Calls that add to a path, and words that relate one class to another.
VERBS = ("get", "post", "put", "patch", "delete", "del", "options", "any", "under", "websocket", "route", "bridge")
RELATIONS = ("belongs_to", "has_many", "has_one", "might_have", "many_to_many")
_STEP = r"->\w+(?:\s*\((?:'[^']*'|[^()']|\((?:'[^']*'|[^()'])*\))*\))?"
_STATE = "struct<path:string,method:string,controller:string,action:string,name:string,leads:boolean>"


def camelized(token: Column) -> Column:
    """The class that a route's controller names: dashes part packages, underscores part words; a capital at the start means it is one."""
    words = lambda part: F.array_join(F.transform(F.split(part, "_"), lambda w: F.initcap(w)), "")
    return F.when(token.rlike("^[A-Z]"), token).otherwise(F.array_join(F.transform(F.split(token, "-"), words), "::"))


def _after(state: Column, step: Column) -> Column:
    """What a chain says after one more call."""
    verb = F.regexp_extract(step, r"^->(\w+)", 1)
    first = F.nullif(F.regexp_extract(step, r"^->\w+\s*\(\s*(?:\[\s*\(?\s*(?:'?\w+'?\s*,?\s*)*\)?\s*\]\s*(?:=>|,)\s*)?'([^']*)'", 1), F.lit(""))
    named = lambda key: got(step, rf"\b{key}'?\s*=>\s*'([^']*)'")
    adds, to = verb.isin(*VERBS), verb == "to"
    path = F.when(adds, F.concat(state["path"], F.when(first.startswith("/"), first).otherwise(F.coalesce(F.concat(F.lit("/"), first), F.lit(""))))).otherwise(state["path"])
    target = F.when(to & first.contains("#"), first)
    part = lambda i: F.nullif(F.split_part(target, F.lit("#"), F.lit(i)), F.lit(""))
    return F.struct(
        path.alias("path"), F.when(adds, verb).otherwise(state["method"]).alias("method"),
        F.coalesce(F.when(to, F.coalesce(part(1), named("controller"))), state["controller"]).alias("controller"),
        F.coalesce(F.when(to, F.coalesce(part(2), named("action"))), state["action"]).alias("action"),
        F.coalesce(F.when(verb == "name", first), state["name"]).alias("name"), (state["leads"] | to).alias("leads"),
    ).cast(_STATE)


def _upon(base: Column, own: Column) -> Column:
    """A chain that goes on from another one."""
    return F.struct(F.concat(base["path"], own["path"]).alias("path"), F.coalesce(own["method"], base["method"]).alias("method"), F.coalesce(own["controller"], base["controller"]).alias("controller"), F.coalesce(own["action"], base["action"]).alias("action"), own["name"].alias("name"), own["leads"].alias("leads")).cast(_STATE)


def routes(rows: DataFrame, rounds: int = 16) -> DataFrame:
    """file_id, line, package, method, path, controller, action, class, name: every route, with what it has from its bases."""
    code = live(rows).where(F.col("norm").contains("->"))
    found = code.select(
        "file_id", "at", "line", "package", F.coalesce("sub_line", F.lit(-1)).alias("sub"),
        got("norm", r"^(?:(?:my|our|local)\s+)?(\$\w+)\s*=[^=~>]").alias("var"), got("norm", rf"(?:^|=\s*|\breturn\s+)(\$\w+)\s*(?:{_STEP})").alias("on"),
        every("norm", rf"({_STEP})").alias("steps"),
    )
    start = F.struct(F.lit("").alias("path"), F.lit(None).alias("method"), F.lit(None).alias("controller"), F.lit(None).alias("action"), F.lit(None).alias("name"), F.lit(False).alias("leads")).cast(_STATE)
    rooted = F.array_contains(F.transform("steps", lambda s: F.regexp_extract(s, r"^->(\w+)", 1)), "routes")
    chains = cut(found.select("file_id", "at", "line", "package", "sub", "var", F.when(~rooted, F.col("on")).alias("on"), rooted.alias("rooted"), F.aggregate("steps", start, _after).alias("state")))
    # the base of a chain is the last one assigned to its variable before it, which may be the same variable
    assigned = chains.where("var is not null").select("file_id", "sub", F.col("var").alias("on"), (F.col("at") + 1).alias("at"), F.col("at").alias("base"))
    points = chains.where("on is not null").select("file_id", "sub", "on", "at")
    based = S.as_of(points, assigned, ["file_id", "sub", "on"], ["at"], "base").select("file_id", "at", "base")
    now = cut(chains.join(based, ["file_id", "at"], "left").drop("sub", "var", "on"))
    for _ in range(rounds):
        if now.where("base is not null").isEmpty():
            break
        b = now.select("file_id", F.col("at").alias("base"), F.col("state").alias("b_state"), F.col("rooted").alias("b_rooted"), F.col("base").alias("b_base"))
        both = now.join(b, ["file_id", "base"], "left")
        now = cut(both.select("file_id", "at", "line", "package", (F.col("rooted") | F.coalesce("b_rooted", F.lit(False))).alias("rooted"), F.when(F.col("b_state").isNotNull(), _upon(F.col("b_state"), F.col("state"))).otherwise(F.col("state")).alias("state"), F.col("b_base").alias("base")))
    s = now.where("rooted and state.leads and state.controller is not null and state.action is not null")
    return s.select("file_id", "line", "package", "state.method", F.nullif(F.col("state.path"), F.lit("")).alias("path"), "state.controller", "state.action", camelized(F.col("state.controller")).alias("class"), "state.name")


def tasks(rows: DataFrame) -> DataFrame:
    """file_id, line, kind (task, enqueue), name: tasks of a job queue, and the places that put one into it."""
    of = lambda kind, verb: F.transform(every("norm", rf"->{verb}\(\s*'?([\w.:-]+)'?\s*(?:=>|,|\))"), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    return live(rows).select("file_id", "line", F.explode(F.concat(of("task", "add_task"), of("enqueue", "enqueue(?:_p)?"))).alias("x")).select("file_id", "line", "x.*")


def mapped(rows: DataFrame) -> DataFrame:
    """file_id, line, package, kind (column, or the relation), name, class (of a relation): the accessors that an object mapper makes."""
    args = F.regexp_extract("norm", r"^(?:__PACKAGE__|[\w:]+)\s*->\s*add_columns?\s*\((.*)\)", 1)
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(args, r"\{[^{}]*\}", "%"), r"\{[^{}]*\}", "%"), r"\{[^{}]*\}", "%")  # what describes a column
    names = F.transform(every(F.regexp_replace(flat, r"\s*=>\s*%", ""), r"'?\+?([A-Za-z_]\w*)'?"), lambda x: F.struct(F.lit("column").alias("kind"), x.alias("name"), F.lit(None).cast("string").alias("class")))
    head = rf"^(?:__PACKAGE__|[\w:]+)\s*->\s*({'|'.join(RELATIONS)})\s*\(\s*'?(\w+)'?\s*(?:=>|,)\s*'([\w:]+)'"
    relation = F.when(F.col("norm").rlike(head), F.array(F.struct(got("norm", head).alias("kind"), got("norm", head, 2).alias("name"), got("norm", head, 3).alias("class"))))
    kind = "array<struct<kind:string,name:string,class:string>>"
    both = F.concat(names.cast(kind), F.coalesce(relation, F.array().cast(kind)).cast(kind))
    return live(rows).select("file_id", "line", "package", F.explode(both).alias("x")).select("file_id", "line", "package", "x.*")
