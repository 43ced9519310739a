"""Questions over extracted facts: types at a place, definitions of types, signatures, bindings, ranges, keys and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.functions.extension import argument_slot
from factloom.operators import extract as X
from factloom.operators.graph import closure, dealt

#: Variables that stand for the package's own object or class.
INVOCANTS = ("$self", "$class")
#: Methods that bind a handler to the name of an event.
DISPATCHERS = ("on", "emit", "subscribe")


def mentions(rows: DataFrame) -> DataFrame:
    """file_id, package, sub, line, var: the scalar variables that a line names."""
    return X.live(rows).where("sub is not null").select("file_id", "package", "sub", "line", F.explode(F.array_distinct(X.every("code", r"(\$\w+)"))).alias("var"))


def bindings(rows: DataFrame) -> DataFrame:
    """file_id, sub, line, var, chain: variables bound to what a chain of calls returns."""
    bound, chain = X.got("norm", r"^(?:my\s+)?(\$\w+)\s*=[^=~]"), X.got("norm", r"=\s*((?:\$\w+|[A-Z]\w*(?:::\w+)*)(?:->\w+)+)(?:\(\s*\))?\s*;?$")
    return X.live(rows).where("sub is not null").select("file_id", "sub", "line", bound.alias("var"), chain.alias("chain")).where("var is not null and chain is not null")


def typed_chains(rows: DataFrame) -> DataFrame:
    return X.chain_types(X.chains(rows), X.method_types(rows), X.witnesses(rows), X.inherits(rows))


def variable_types(rows: DataFrame) -> DataFrame:
    """file_id, sub, line, attachment, type: witnesses of variables, with those that are bound to a typed chain."""
    through = bindings(rows).join(dealt(typed_chains(rows).select("file_id", "sub", "line", "chain", "type")), ["file_id", "sub", "line", "chain"]).where("type is not null")
    own = X.witnesses(rows).where(F.col("attachment").startswith("$"))
    return own.unionByName(through.select("file_id", "sub", "line", F.col("var").alias("attachment"), "type")).distinct()


def type_at(rows: DataFrame) -> DataFrame:
    """file_id, sub, line, var, type of every mention whose type is known: narrowed, else last witnessed, else the invocant's package.

    Witnesses and mentions of one variable of a sub meet in one ordered pass; a narrowed region is joined by sub and variable.
    """
    places = mentions(rows).select("file_id", "package", "sub", "var", "line", F.lit(None).cast("string").alias("type"))
    known = variable_types(rows).select("file_id", F.lit(None).cast("string").alias("package"), "sub", F.col("attachment").alias("var"), "line", "type")
    w = Window.partitionBy("file_id", "sub", "var").orderBy("line").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = places.unionByName(known).withColumn("last", F.last("type", ignorenulls=True).over(w)).where("package is not null")
    spans = X.narrowings(rows).select("file_id", "sub", "var", F.col("type").alias("proved"), "from_line", "to_line")
    met = seen.join(dealt(spans), ["file_id", "sub", "var"], "left").withColumn("inside", F.col("line").between(F.col("from_line"), F.col("to_line")))
    own = F.when(F.col("var").isin(*INVOCANTS), F.col("package"))
    best = met.groupBy("file_id", "package", "sub", "var", "line", "last").agg(F.max_by("proved", F.when(F.col("inside"), F.col("from_line"))).alias("proved"))
    return best.select("file_id", "package", "sub", "line", "var", F.coalesce("proved", "last", own).alias("type")).where("type is not null")


def packages(rows: DataFrame) -> DataFrame:
    """class, def_file, def_line: where a package is declared first."""
    own = X.declarations(rows).where("kind = 'package'")
    return own.groupBy(F.col("name").alias("class")).agg(F.min(F.struct("file_id", "line")).alias("x")).select("class", F.col("x.file_id").alias("def_file"), F.col("x.line").alias("def_line"))


def type_definitions(rows: DataFrame) -> DataFrame:
    """Mentions of variables of a class, with the place that declares the class."""
    return type_at(rows).withColumnRenamed("type", "class").join(dealt(packages(rows)), "class").select("file_id", "line", "var", "class", "def_file", "def_line")


def stamped_calls(rows: DataFrame) -> DataFrame:
    """file_id, line, receiver, name, class, def_file, def_line: each method call with the class it is sent to and what answers there."""
    sends = X.calls(rows).where("kind = 'method'")
    typed = type_at(rows).select("file_id", "sub", "line", F.col("var").alias("receiver"), "type")
    of = sends.join(dealt(typed), ["file_id", "sub", "line", "receiver"], "left").withColumn("class", F.when(F.col("receiver").startswith("$"), F.col("type")).otherwise(F.col("receiver")))
    subs = X.declarations(rows).where("kind = 'sub'").select(F.col("package").alias("node"), "name", F.col("file_id").alias("def_file"), F.col("line").alias("def_line"))
    made = X.accessors(rows).select(F.col("package").alias("node"), "name", F.col("file_id").alias("def_file"), F.col("line").alias("def_line"))
    up = closure(X.inherits(rows), of.where("class is not null").select(F.col("class").alias("origin")).distinct(), include_self=True)
    answers = up.join(dealt(subs.unionByName(made)), "node").groupBy(F.col("origin").alias("class"), "name").agg(F.min(F.struct("depth", "def_file", "def_line")).alias("x"))
    found = answers.select("class", "name", "x.def_file", "x.def_line")
    return of.join(dealt(found), ["class", "name"], "left").select("file_id", "line", "receiver", "name", "class", "def_file", "def_line")


def binding_edges(rows: DataFrame) -> DataFrame:
    """file_id, sub, line, var, class, method: the method whose result a variable is bound to, by the class it is sent to."""
    links = X.chains(rows).withColumn("method", F.element_at("steps", -1)).withColumn("whole", F.col("chain"))
    before = X.chain_types(links.withColumn("steps", F.slice("steps", F.lit(1), F.size("steps") - 1)), X.method_types(rows), X.witnesses(rows), X.inherits(rows))
    method = F.regexp_extract("chain", r"->(\w+)$", 1)
    return bindings(rows).join(dealt(before.select("file_id", "sub", "line", "chain", F.col("type").alias("class"))), ["file_id", "sub", "line", "chain"]).select("file_id", "sub", "line", "var", "class", method.alias("method"))


def signatures(rows: DataFrame) -> DataFrame:
    """file_id, line, name, label, slot: calls of a package's own methods with the callee's parameters and the last argument's number."""
    method = r"((?:\$self|[A-Z]\w*(?:::\w+)*)->\w+)(?:\(([^;]*)\))?"
    sent = X.live(rows).where("sub is not null").select("file_id", "line", "package", X.got("norm", method).alias("call"), F.regexp_extract("norm", method, 2).alias("args")).where("call is not null")
    owner, name = F.split_part("call", F.lit("->"), F.lit(1)), F.split_part("call", F.lit("->"), F.lit(2))
    sent = sent.select("file_id", "line", F.when(owner == "$self", F.col("package")).otherwise(owner).alias("class"), name.alias("name"), argument_slot(F.col("args")).alias("slot"))
    rest = F.filter("params", lambda p: ~p.isin(*INVOCANTS))
    told = X.parameters(rows).select(F.col("package").alias("class"), F.col("sub").alias("name"), F.concat(F.col("sub"), F.lit("("), F.array_join(rest, ", "), F.lit(")")).alias("label"))
    return sent.join(dealt(told), ["class", "name"]).select("file_id", "line", "name", "label", F.col("slot").cast("int").alias("slot"))


def leading_docs(rows: DataFrame) -> DataFrame:
    """file_id, sub, doc: the comment lines that stand directly above a sub."""
    note = X.got("text", r"^\s*#\s?(.*)$")
    notes = rows.where("kind = 'comment'").where(note.isNotNull()).select("file_id", "line", note.alias("note"))
    w = Window.partitionBy("file_id").orderBy("line")
    island = notes.withColumn("island", F.col("line") - F.row_number().over(w)).groupBy("file_id", "island").agg(F.max("line").alias("last"), F.array_sort(F.collect_list(F.struct("line", "note"))).alias("x"))
    docs = island.select("file_id", (F.col("last") + 1).alias("line"), F.array_join(F.transform("x", lambda r: r["note"]), "\n").alias("doc"))
    subs = X.live(rows).select("file_id", "line", X.got("text", r"^\s*sub\s+(\w+)").alias("sub")).where("sub is not null")
    return subs.join(dealt(docs), ["file_id", "line"]).select("file_id", "sub", "doc")


def folding_ranges(rows: DataFrame) -> DataFrame:
    """file_id, start_line, end_line: blocks of several lines, from what closes them."""
    return X.live(rows).where("ends > 0 and line > opened").select("file_id", F.col("opened").alias("start_line"), F.col("line").alias("end_line"))


def linked_ranges(rows: DataFrame, name: str) -> DataFrame:
    """file_id, sub, line, col: every place of a variable, spelt as it is, in the subs that name it."""
    own = X.live(rows).where(F.col("sub").isNotNull())
    return own.select("file_id", "sub", F.explode(F.filter("vars", lambda v: v["name"] == name)).alias("v")).select("file_id", "sub", "v.line", "v.col")


def own_keys(rows: DataFrame) -> DataFrame:
    """package, key: what completion offers behind a package's own object, the keys of its ancestors among them."""
    defined, _ = X.self_keys(rows)
    up = closure(X.inherits(rows), X.declarations(rows).where("kind = 'package'").select(F.col("name").alias("origin")).distinct(), include_self=True)
    return up.join(dealt(defined.select(F.col("package").alias("node"), "key").distinct()), "node").select(F.col("origin").alias("package"), "key").distinct()


def handlers(rows: DataFrame) -> DataFrame:
    """package, dispatcher, event: names that are bound by a dispatching method of the package's own object."""
    pattern = r"\$self->(" + "|".join(DISPATCHERS) + r")\(\s*'(\w+)'"
    return X.live(rows).select("package", X.got("norm", pattern).alias("dispatcher"), X.got("norm", pattern, 2).alias("event")).where("event is not null").distinct()


def cursor_context(prefix: Column) -> Column:
    """What kind of name is being typed at the end of the prefix of a line."""
    kinds = ((r"^\s*use\s+[\w:]*$", "module"), (r"->\{\w*$", "hash_key"), (r"->\w*$", "method"), (r"[$@%]\w*$", "variable"), (r"(^|[^\w])(\"[^\"]*|'[^']*)$", "string"), (r"\w+$", "name"))
    out = F.lit("none")
    for pattern, kind in reversed(kinds):
        out = F.when(prefix.rlike(pattern), kind).otherwise(out)
    return out


def member_access(events: DataFrame) -> DataFrame:
    """Members of each file's events (of the pack) with the access that was open, and whether others may see them."""
    w = Window.partitionBy("file_id").orderBy("line", "capture")
    access = F.last(F.when(F.col("capture") == "context.access", F.col("name")), ignorenulls=True).over(w)
    members = events.withColumn("access", F.coalesce(access, F.lit("private"))).where(F.col("capture").isin("def.sub", "def.field"))
    return members.select("file_id", "name", "access", (F.col("access") == "public").alias("visible"))


def includers(events: DataFrame) -> DataFrame:
    """header, n_includers, first: who includes a header; counts and least ids, no lists."""
    return events.where("capture = 'import'").groupBy(F.col("name").alias("header")).agg(F.count_distinct("file_id").alias("n_includers"), F.min("file_id").alias("first"))


def path_keys(declared: DataFrame) -> DataFrame:
    """file_id, path: nested declarations by their path of names."""
    inner = F.when((F.col("kind") == "package") | (F.col("kind") == "sub") & (F.col("name") == F.col("sub")), F.lit(None)).otherwise(F.col("sub"))
    return declared.select("file_id", F.when(F.col("kind") == "package", F.col("name")).otherwise(F.concat_ws("::", "package", inner, "name")).alias("path")).distinct()
