"""Facts from source text: declared capture patterns over statements, and the rows that follow from them.

``statements`` reads a file into statements with their scopes; nothing is shuffled for that. All else is a projection of
statements, or a join of such projections, over their normal form, in which word lists and strings of any quoting look
alike and a construct spread over lines is one row. Languages with packs of their own are split into lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.operators.graph import closure, cut, dealt
from factloom.operators.statements import statements  # noqa: F401

#: Nesting up to which a file is analysed.
MAX_DEPTH = 64
#: Words before a parenthesis that are no calls, and functions of the language itself.
NOT_CALLS = ("qw", "if", "unless", "while", "until", "for", "foreach", "return", "my", "our", "local", "state", "sub", "and", "or", "not", "elsif", "x", "eq", "ne", "lt", "gt", "le", "ge", "cmp", "xor", "when", "given", "catch")
BUILTINS = ("print", "push", "shift", "bless", "defined", "ref", "die", "keys", "values", "scalar", "join", "map", "grep", "sort")
#: Capture patterns by language: (capture, pattern); what is captured is the pattern's first group.
PACKS: dict[str, tuple[tuple[str, str], ...]] = {
    "perl": (("def.package", r"^\s*package\s+([\w:]+)"), ("def.sub", r"^\s*sub\s+(\w+)"), ("def.var", r"\b(?:my|our)\s+([$@%]\w+)"), ("import", r"^\s*use\s+([A-Z][\w:]*)"), ("ref.method", r"->(\w+)"), ("ref.key", r"->\{(\w+)\}"), ("ref.call", r"(?<![\w$>:&])([a-z_]\w*)\((?<!qw\()")),
    "python": (("def.class", r"^\s*class\s+(\w+)"), ("def.sub", r"^\s*def\s+(\w+)"), ("import", r"^\s*(?:import|from)\s+([\w.]+)"), ("base", r"^\s*class\s+\w+\((\w+)\)"), ("ref.call", r"^(?!\s*(?:class|def)\b).*?\b(\w+)\(")),
    "cpp": (("def.namespace", r"^\s*namespace\s+(\w+)"), ("def.class", r"^\s*(?:class|struct)\s+(\w+)"), ("def.sub", r"^\s*\w[\w:<>*& ]*\s[*&]?(\w+)\([^)]*\)\s*;"), ("def.field", r"^\s+\w[\w:<>*& ]*\s[*&]?(\w+)\s*;"), ("import", r"^\s*#\s*include\s+[<\"]([^>\"]+)"), ("base", r":\s*public\s+(\w+)"), ("context.access", r"^\s*(public|private|protected)\s*:")),
    "r": (("def.sub", r"^\s*(\w+)\s*<-\s*function"), ("import", r"^\s*library\((\w+)\)"), ("ref.call", r"^\s+(\w+)\(")),
    "cmake": (("import", r"^\s*find_package\((\w+)"), ("def.target", r"^\s*add_(?:library|executable)\((\w+)"), ("ref.target", r"^\s*target_link_libraries\(\w+\s+(\w+)")),
}


def got(text: Column | str, pattern: str, group: int = 1) -> Column:
    """The group where the pattern matches, else null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def every(text: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def lines(sources: DataFrame) -> DataFrame:
    """line and its text for each line of sources (file_id, text, others kept)."""
    rest = [c for c in sources.columns if c != "text"]
    return sources.select(*rest, F.posexplode(F.split("text", "\n")).alias("line", "text"))


def too_deep(rows: DataFrame, limit: int = MAX_DEPTH) -> DataFrame:
    """One finding for each file (of statements) that is not analysed."""
    files = rows.groupBy("file_id").agg(F.max("deepest").alias("depth")).where(F.col("depth") > limit)
    return files.select("file_id", F.lit("not-analysed").alias("rule"), F.lit("info").alias("severity"), "depth")


def scoped(rows: DataFrame, limit: int = MAX_DEPTH) -> DataFrame:
    """Statements of files that are analysed."""
    return rows.where(F.col("deepest") <= limit)


def events(rows: DataFrame, lang: str | Column) -> DataFrame:
    """file_id, line, capture, name: what the pack of the language finds, one row for each match."""
    over = "code" if "code" in rows.columns else "text"  # of statements, what stands in strings is no event

    def of(capture: str, pattern: str) -> Column:
        return F.transform(every(over, pattern), lambda x: F.struct(F.lit(capture).alias("capture"), x.alias("name")))

    def found(pack: tuple[tuple[str, str], ...]) -> Column:
        return F.flatten(F.array(*[of(*p) for p in pack]))

    if isinstance(lang, str):
        hits = found(PACKS[lang])
    else:
        hits = F.array().cast("array<struct<capture:string,name:string>>")
        for x, pack in PACKS.items():
            hits = F.when(lang == x, found(pack)).otherwise(hits)
    return rows.select("file_id", *(c for c in ("lang", "package", "sub") if c in rows.columns), "line", F.explode(hits).alias("x")).select("*", "x.*").drop("x").where(F.col("name") != "")


def live(rows: DataFrame) -> DataFrame:
    """Code before the end mark, without comments and documentation."""
    return rows.where("kind = 'code'")


def quoted(text: Column | str) -> Column:
    """The strings of a normal form that hold words and signs of names only, leaving out what stands in braces."""
    plain = F.regexp_replace(text, r"\{[^{}]*\}", "")
    return every(plain, r"'([\w:&$@%*-]+)'")


#: Head of a named sub, with its name; the signature is the second group.
SUB = r"^(?:sub|method)\s+((?:\w+::)*\w+)\s*(?:\(([^)]*)\))?"
#: A list of variables, each with a default perhaps.
_SIGNED = r"([$@%]\w+)\s*(?:(?://|\|\|)?=\s*[^,]*)?(?:,|$)"


def parameters(rows: DataFrame) -> DataFrame:
    """file_id, package, sub, params: of every sub that unpacks its arguments into a list, or has a signature."""
    inner = got("norm", r"^my\s*\(([^)]*)\)\s*=\s*@_")
    unpacked = F.when(inner.isNotNull(), F.split(inner, r"\s*,\s*"))
    signed = every(F.regexp_extract("norm", SUB, 2), _SIGNED)
    found = F.coalesce(unpacked, F.when(F.size(signed) > 0, signed))
    return live(rows).select("file_id", "package", "sub", found.alias("params")).where("params is not null and sub is not null")


def declarations(rows: DataFrame) -> DataFrame:
    """file_id, line, kind, name, package, sub: packages, subs, globs that are assigned, variables, loop variables and parameters."""
    def of(kind: str, text: str, pattern: str) -> Column:
        return F.transform(every(text, pattern), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))

    listed = F.concat(F.flatten(F.transform(every("code", r"\bmy\s*\(([^)]*)\)"), lambda x: F.split(x, r"\s*,\s*"))), every(F.regexp_extract("norm", SUB, 2), _SIGNED))
    kinds = [of("package", "norm", r"^(?:package|class|role)\s+([\w:]+)"), of("sub", "norm", r"^(?:sub|method)\s+(?:\w+::)*(\w+)"), of("glob", "norm", r"^\*((?:\w+::)*\w+)\s*="), of("variable", "code", r"\b(?:my|our|state)\s+([$@%]\w+)"), of("loop", "code", r"\bfor(?:each)?\s+my\s+(\$\w+)")]
    kinds.append(F.transform(F.filter(listed, lambda x: x != "undef"), lambda x: F.struct(F.lit("parameter").alias("kind"), x.alias("name"))))
    return live(rows).select("file_id", "line", F.explode(F.flatten(F.array(*kinds))).alias("x"), "package", "sub").select("file_id", "line", "x.kind", "x.name", "package", "sub")


def calls(rows: DataFrame) -> DataFrame:
    """file_id, line, kind (function, qualified, method), receiver, name, package, sub; __PACKAGE__ is the package itself."""
    struct = lambda kind, receiver, name: F.struct(F.lit(kind).alias("kind"), receiver.alias("receiver"), name.alias("name"))
    none = F.lit(None).cast("string")
    code = F.regexp_replace("code", r"^(?:use|no)\s+[\w:]+|^(?:sub|method)\s+[\w:]+\s*(?:\([^)]*\))?", "")
    plain = F.transform(F.filter(every(code, r"(?<![\w$@%>:&])([A-Za-z_]\w*)\s?\("), lambda x: ~x.isin(*NOT_CALLS)), lambda x: struct("function", none, x))
    full = F.transform(every(code, r"(?<![\w$@%>&:])((?:\w+::)+\w+)\("), lambda x: struct("qualified", F.regexp_extract(x, r"^(.*)::\w+$", 1), F.regexp_extract(x, r"::(\w+)$", 1)))
    receiver = lambda x: F.when(F.split_part(x, F.lit("->"), F.lit(1)) == "__PACKAGE__", F.col("package")).otherwise(F.split_part(x, F.lit("->"), F.lit(1)))
    sends = F.transform(every(code, r"((?:\$\w+|(?<![\w$@%>:&}\])-])[A-Za-z_]\w*(?:::\w+)*)->\w+)"), lambda x: struct("method", receiver(x), F.split_part(x, F.lit("->"), F.lit(2))))
    return live(rows).select("file_id", "line", F.explode(F.concat(plain, full, sends)).alias("x"), "package", "sub").select("file_id", "line", "x.*", "package", "sub")


#: Statements that name parents: pragmas, words of object systems, assignments to the list itself.
PARENTS = r"^(?:use\s+(?:parent|base|Mojo::Base)\b|(?:extends|with)\b|(?:(?:our|local)\s+)?@(?:\w+::)*ISA\s*=|push\s*\(?\s*@(?:\w+::)*ISA\b)"


def uses(rows: DataFrame) -> DataFrame:
    """file_id, line, kind (import, constant, parent, root, assignment), name, value, package."""
    struct = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"))
    none, nothing = F.lit(None).cast("string"), F.array().cast("array<struct<kind:string,name:string,value:string>>")
    module = got("norm", r"^use\s+([A-Z][\w:]*)")
    names = every(F.regexp_extract("norm", r"^use\s+[\w:]+\s+(?:[\d.]+\s+)?(.*)$", 1), r"'([^']*)'")
    imports = F.transform(F.when(F.size(names) > 0, names).otherwise(F.array(none)), lambda x: struct("import", module, F.nullif(x, F.lit(""))))
    parents = F.transform(F.filter(quoted("norm"), lambda x: ~x.startswith("-")), lambda x: struct("parent", x, none))
    isa = F.array(struct("parent", got("norm", r"^class\s+[\w:]+.*?:\s*isa\(\s*([\w:]+)"), none))
    constant = F.array(struct("constant", got("norm", r"^use\s+constant\s+(\w+)\s*=>"), got("text", r"=>\s*(.*?);\s*$")))
    pairs = every(F.regexp_extract("norm", r"^use\s+constant\s+\{(.*)\}", 1), r"(\w+\s*=>\s*(?:\[[^\]]*\]|'[^']*'|[^,\[\]]*))")
    constants = F.transform(pairs, lambda x: struct("constant", F.regexp_extract(x, r"^(\w+)", 1), F.trim(F.regexp_extract(x, r"=>\s*(.*)$", 1))))
    roots = F.transform(F.when(F.col("norm").rlike(r"^use\s+lib\b"), every("norm", r"'([^']+)'")), lambda x: struct("root", x, none))
    assigned = F.array(struct("assignment", got("text", r"^\s*(?:(?:my|our|local|state)\s+)?([$@%]\w+)\s*=[^=~]"), got("text", r"^\s*(?:(?:my|our|local|state)\s+)?[$@%]\w+\s*=\s*(.*?);?\s*$")))
    found = F.concat(F.when(module.isNotNull(), imports).otherwise(nothing), F.when(F.col("norm").rlike(PARENTS), parents).otherwise(nothing), isa, constant, constants, F.coalesce(roots, nothing), assigned)
    return live(rows).select("file_id", "line", F.explode(found).alias("x"), "package").select("file_id", "line", "x.*", "package").where("name is not null")


def accessors(rows: DataFrame) -> DataFrame:
    """file_id, line, package, name, role (getter, accessor, writer, predicate, clearer), type: methods that a has declaration makes.

    One declaration may name several attributes, in any quoting. Without options it is an accessor; ``bare`` makes none, and
    ``rwp`` a getter with a private writer.
    """
    head = got("norm", r"^has\s*\(?\s*(\[[^\]]*\]|'[^']*'|\w+)")
    names = F.when(head.rlike(r"^\w+$"), F.array(head)).otherwise(every(head, r"'\+?(\w+)'"))
    generated = F.when(F.col("norm").rlike(r"->mk_(?:ro_)?accessors\("), quoted("norm"))
    kind = got("norm", r"\bis\s*=>\s*'(\w+)'")
    said = got("norm", r"\bisa\s*=>\s*('(?:[^'\\]|\\.)+'|\"[^\"]+\"|\w+(?:\[[^\]]*\])?)")
    type_ = F.coalesce(got(said, r"InstanceOf\[\\?'([\w:]+)"), F.regexp_replace(said, r"^['\"]|['\"]$", ""))
    role = F.when(kind == "rw", "accessor").when(kind.isNotNull() | F.col("norm").rlike("->mk_ro_"), "getter").when(F.col("norm").rlike(r"=>\s*\("), "getter").otherwise("accessor")
    none = F.lit(None).cast("string")
    made = lambda name, role, kind: F.struct(name.alias("name"), role.alias("role"), kind.alias("type"))

    def more(word: str, prefix: str) -> Column:
        given = got("norm", r"\b" + word + r"\s*=>\s*'(\w+)'")
        return made(F.when(F.col("norm").rlike(r"\b" + word + r"\s*=>\s*1\b"), F.concat(F.lit(prefix), "attribute")).otherwise(given), F.lit(word), none)

    found = live(rows).withColumn("attribute", F.explode(F.coalesce(generated, names))).withColumn("made_as", kind)
    own = F.when(F.coalesce(kind, F.lit("")) != "bare", made(F.col("attribute"), role, type_))
    writer = F.when(kind == "rwp", made(F.concat(F.lit("_set_"), "attribute"), F.lit("writer"), none))
    each = F.explode(F.array(own, writer, more("predicate", "has_"), more("clearer", "clear_"))).alias("x")
    return found.select("file_id", "line", "package", each).select("file_id", "line", "package", "x.*").where("name is not null")


def exports(rows: DataFrame) -> DataFrame:
    """file_id, package, tag (null for the lists themselves), name, always: the export table of a package."""
    listed = F.transform(F.when(F.col("norm").rlike(r"@(?:\w+::)*EXPORT(?:_OK)?\s*(?:=|,)"), quoted("norm")), lambda x: F.struct(F.lit(None).cast("string").alias("tag"), x.alias("name")))
    tags = every(F.regexp_extract("norm", r"%(?:\w+::)*EXPORT_TAGS\s*=\s*\((.*)\)", 1), r"(\w+'?\s*=>\s*\[[^\]]*\])")
    tagged = F.flatten(F.transform(tags, lambda t: F.transform(every(F.regexp_extract(t, r"=>\s*(.*)$", 1), r"'([^']+)'"), lambda x: F.struct(F.regexp_extract(t, r"^(\w+)", 1).alias("tag"), x.alias("name")))))
    always = F.col("norm").rlike(r"@(?:\w+::)*EXPORT\s*(=|,)")
    nothing = F.array().cast("array<struct<tag:string,name:string>>")
    return live(rows).select("file_id", "package", F.explode(F.concat(F.coalesce(listed, nothing), tagged)).alias("x"), always.alias("always")).select("file_id", "package", "x.tag", "x.name", "always").distinct()


def flows(rows: DataFrame) -> DataFrame:
    """file_id, sub, line, kind (assign, argument, return), src, dst: values that flow from variable to variable, call or result."""
    struct = lambda kind, src, dst: F.struct(F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"))
    assign = F.array(struct("assign", got("norm", r"^(?:my\s+)?\$\w+\s*=\s*(\$\w+)\s*;"), got("norm", r"^(?:my\s+)?(\$\w+)\s*=\s*\$\w+\s*;")))
    args = F.transform(every(F.regexp_extract("norm", r"(?<![\w$&:])(?!(?:if|unless|while|my|return|qw|for|foreach)\b)\w+\(([^()]*)\)", 1), r"(\$\w+)(?=\s*(?:,|$))"), lambda x: struct("argument", x, got("norm", r"((?:\$\w+->)?\w+)\([^()]*\)\s*;")))
    back = F.array(struct("return", got("norm", r"^return\s+(\$\w+)\s*;?$"), F.col("sub")))
    return live(rows).where("sub is not null").select("file_id", "sub", "line", F.explode(F.concat(assign, args, back)).alias("x")).select("file_id", "sub", "line", "x.*").where("src is not null and dst is not null")


#: Representations that ref() names, and the type each proves.
REPRESENTATIONS = {"HASH": "HashRef", "ARRAY": "ArrayRef", "CODE": "CodeRef", "SCALAR": "ScalarRef"}


def narrowings(rows: DataFrame) -> DataFrame:
    """file_id, sub, var, type, from_line, to_line: regions in which a guard has proved a variable's type.

    A block's guard holds to the block's end, an early exit's from the next line to the end of the sub; both end where the
    variable is bound anew.
    """
    own = live(rows).where("sub is not null")
    named = F.create_map(*[F.lit(x) for p in REPRESENTATIONS.items() for x in p])
    block = lambda p, g: got("norm", r"^(?:if|elsif|while)\s*\(.*?" + p, g)
    exits = r"^(?:return|die|croak|confess|next|last)\b.*\b"
    found = F.array(
        F.struct(block(r"\bref\s*\(?(\$\w+)\)?\s+eq\s+'(\w+)'", 1).alias("var"), F.try_element_at(named, block(r"\bref\s*\(?(\$\w+)\)?\s+eq\s+'(\w+)'", 2)).alias("type"), F.lit(True).alias("block")),
        F.struct(block(r"(\$\w+)->isa\('([\w:]+)'\)", 1).alias("var"), block(r"(\$\w+)->isa\('([\w:]+)'\)", 2).alias("type"), F.lit(True).alias("block")),
        F.struct(block(r"(?<!!)\bdefined\s*\(?(\$\w+)", 1).alias("var"), F.lit("Defined").alias("type"), F.lit(True).alias("block")),
        F.struct(got("norm", exits + r"unless\s+defined\s*\(?(\$\w+)").alias("var"), F.lit("Defined").alias("type"), F.lit(False).alias("block")),
        F.struct(got("norm", exits + r"unless\s+ref\s*\(?(\$\w+)\)?\s+eq\s+'(\w+)'").alias("var"), F.try_element_at(named, got("norm", exits + r"unless\s+ref\s*\(?(\$\w+)\)?\s+eq\s+'(\w+)'", 2)).alias("type"), F.lit(False).alias("block")),
        F.struct(got("norm", exits + r"unless\s+(\$\w+)->isa\('([\w:]+)'\)").alias("var"), got("norm", exits + r"unless\s+(\$\w+)->isa\('([\w:]+)'\)", 2).alias("type"), F.lit(False).alias("block")),
    )
    guards = own.select("file_id", "sub", "sub_line", F.col("line").alias("at"), F.col("depth").alias("at_depth"), F.explode(found).alias("g")).select("*", "g.*").drop("g").where("var is not null and type is not null")
    bound = F.transform(every("norm", r"(?:^|[({;])\s*(?:my\s+)?(\$\w+)\s*=[^=~]"), lambda x: x)
    # a guard meets the lines of its own sub only
    later = own.select("file_id", "sub_line", "line", "depth", "ends", bound.alias("bound"))
    met = guards.join(dealt(later), ["file_id", "sub_line"]).where("line > at")
    ends = F.when(F.array_contains("bound", F.col("var")), F.col("line")).when(F.col("block") & (F.col("depth") - F.col("ends") <= F.col("at_depth")), F.col("line"))
    per = met.groupBy("file_id", "sub", "var", "type", "at").agg(F.min(ends).alias("end"), F.max("line").alias("last"))
    return per.select("file_id", "sub", "var", "type", (F.col("at") + 1).alias("from_line"), F.coalesce(F.col("end") - 1, F.col("last")).alias("to_line")).where("from_line <= to_line")


def expression_type(e: Column) -> Column:
    """The type that an expression's form gives: literals, operators, constructors; null where only a join can tell."""
    return (
        F.when(e.rlike(r"^-?\d+(\.\d+)?$"), "Num").when(e.rlike(r"^('[^']*'|\"[^\"]*\")$"), "Str").when(e.rlike(r"^\["), "ArrayRef").when(e.rlike(r"^bless\b"), None)
        .when(e.rlike(r"^\{"), "HashRef").when(e.rlike(r"^sub\b"), "CodeRef").when(e.rlike(r"^[A-Z][\w:]*->new\b"), F.regexp_extract(e, r"^([A-Z][\w:]*)->new\b", 1))
        .when(e.rlike(r"^\$?\w+\s*[-+*/]\s*\$?\w+$"), "Num").when(e.rlike(r"^\S+\s+\.\s+\S+$"), "Str")
    )


def witnesses(rows: DataFrame) -> DataFrame:
    """file_id, sub, line, attachment (variable or sub), type: from assignments, returns and bless."""
    own = live(rows).where("sub is not null")
    value = got("norm", r"^(?:my\s+)?\$\w+\s*=\s*(.*?)\s*;?$")
    kinds = [
        F.struct(got("norm", r"^(?:my\s+)?(\$\w+)\s*=[^=~]").alias("attachment"), expression_type(value).alias("type")),
        F.struct(F.concat(F.lit("&"), "sub").alias("attachment"), expression_type(got("norm", r"^return\s+(.*?)(?:\s+(?:if|unless)\b.*)?\s*;?$")).alias("type")),
    ]
    found = own.select("file_id", "sub", "line", F.explode(F.array(*kinds)).alias("x")).select("file_id", "sub", "line", "x.*").where("attachment is not null and type is not null")
    return found.unionByName(blessed(rows).select("file_id", "sub", "line", F.col("var").alias("attachment"), F.col("class").alias("type")))


def blessed(rows: DataFrame) -> DataFrame:
    """file_id, sub, line, var, class: what bless makes; a class held in a variable is the package's own."""
    own = live(rows).where(F.col("norm").rlike(r"\bbless\b"))
    named = got("norm", r"\bbless\b.*,\s*'([\w:]+)'\s*\)?\s*;")
    var = F.coalesce(got("norm", r"(\$\w+)\s*=\s*bless\b"), got("norm", r"\bbless\s*\(?\s*(\$\w+)"))
    return own.select("file_id", "sub", "line", var.alias("var"), F.coalesce(named, F.col("package")).alias("class")).where("var is not null")


def arity_returns(rows: DataFrame) -> DataFrame:
    """file_id, package, sub, arity (null: any other), type: returns told apart by the number of arguments."""
    count = r"(?:scalar\s*\(?\s*)?@_\s*\)?\s*==\s*(\d+)"
    test = F.coalesce(got("norm", r"\bif\s*\(?\s*" + count), got("head", r"^(?:if|elsif)\s*\(\s*" + count + r"\s*\)")).cast("int")
    value = got("norm", r"^return\s+(.*?)(?:\s+(?:if|unless)\b.*)?\s*;?$")
    return live(rows).where("sub is not null").select("file_id", "package", "sub", test.alias("arity"), expression_type(value).alias("type")).where("type is not null").distinct()


def self_keys(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(defined, used): keys that a package's own objects are given, and those that are read, each file_id, line, package, key."""
    own = live(rows)
    built = F.flatten(F.transform(every("norm", r"\bbless\s*\(?\s*\{(.*)\}\s*,"), lambda x: every(x, r"(\w+)\s*=>")))
    put = every("norm", r"\$self->\{(\w+)\}\s*=[^=~]")
    read = every("norm", r"\$self->\{(\w+)\}(?!\s*=[^=~])")
    out = lambda keys: own.select("file_id", "line", "package", F.explode(keys).alias("key"))
    return out(F.concat(built, put)), out(read)


def key_owners(defined: DataFrame, used: DataFrame, inherits: DataFrame) -> DataFrame:
    """used with owner: the nearest package of the line (the own one first) that defines the key, or null."""
    up = closure(inherits, used.select(F.col("package").alias("origin")).distinct(), include_self=True)
    holders = up.join(dealt(defined.select(F.col("package").alias("node"), "key").distinct()), "node")
    nearest = holders.groupBy(F.col("origin").alias("package"), "key").agg(F.min_by("node", F.struct("depth", "node")).alias("owner"))
    return used.join(dealt(nearest), ["package", "key"], "left")


def inherits(rows: DataFrame) -> DataFrame:
    """Edges (src, dst, kind, ord) of parents."""
    said = rows.where(F.col("norm").rlike(PARENTS) | F.col("norm").rlike(r"^class\s"))  # no other statement names parents
    return uses(said).where("kind = 'parent'").select(F.col("package").alias("src"), F.col("name").alias("dst"), F.lit(1).alias("kind"), F.col("line").alias("ord"))


def pinned_calls(found: DataFrame, declared: DataFrame, used: DataFrame) -> DataFrame:
    """Function calls with the package that the name belongs to: the own one, then an import's, then the language's, else null."""
    plain = found.where("kind = 'function'")
    local = declared.where("kind = 'sub'").select("file_id", "package", "name", F.col("package").alias("own")).distinct()
    imported = used.where("kind = 'import' and value is not null").groupBy("file_id", F.col("value").alias("name")).agg(F.min("name").alias("module"))
    builtin = F.when(F.col("name").isin(*BUILTINS), "CORE")
    out = plain.join(dealt(local), ["file_id", "package", "name"], "left").join(dealt(imported), ["file_id", "name"], "left")
    return out.select("file_id", "line", "name", F.coalesce("own", "module", builtin).alias("pinned"))


def chains(rows: DataFrame) -> DataFrame:
    """file_id, sub, line, root (variable or class), steps (methods): chains of method calls."""
    found = F.explode(every("code", r"((?:\$\w+|(?<![\w$@%>:&}\])-])[A-Z]\w*(?:::\w+)*)(?:->\w+)+)")).alias("chain")
    parts = live(rows).where("sub is not null").select("file_id", "sub", "package", "line", found).withColumn("parts", F.split("chain", "->"))
    return parts.select("file_id", "sub", "package", "line", "chain", F.element_at("parts", 1).alias("root"), F.slice("parts", F.lit(2), F.size("parts") - 1).alias("steps"))


def method_types(rows: DataFrame) -> DataFrame:
    """class, method, type: what an accessor or a sub returns; new returns its class."""
    made = accessors(rows).where("type is not null").select(F.col("package").alias("class"), F.col("name").alias("method"), "type")
    subs = declarations(rows).where("kind = 'sub'").select(F.col("package").alias("class"), F.col("name").alias("method"))
    return made.unionByName(subs.where("method = 'new'").withColumn("type", F.col("class"))).distinct()


def chain_types(found: DataFrame, types: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """found with type: that of its last step, followed step by step through method types of the class and its ancestors.

    roots are (file_id, sub, line, attachment, type) witnesses; a variable takes the last one before its line. A round
    resolves a step of all chains, and there are as many rounds as the longest chain has steps.
    """
    inherited = closure(edges, types.select(F.col("class").alias("origin")).unionByName(edges.select(F.col("src").alias("origin"))).distinct(), include_self=True)
    reach = inherited.join(dealt(types.withColumnRenamed("class", "node")), "node").groupBy(F.col("origin").alias("class"), "method").agg(F.min_by("type", F.struct("depth", "node")).alias("to"))
    reach = cut(reach.select(F.col("class").alias("of"), F.col("method").alias("step"), "to"))
    at = found.withColumn("id", F.struct("file_id", "line", "chain"))
    known = roots.select("file_id", "sub", F.col("line").alias("w"), F.col("attachment").alias("root"), F.col("type").alias("known"))
    seen = at.join(dealt(known), ["file_id", "sub", "root"], "left").where("w is null or w < line")
    one = seen.groupBy("file_id", "sub", "package", "line", "chain", "root", "steps").agg(F.max_by("known", "w").alias("known"))
    start = F.when(F.col("root").isin("$self", "$class"), F.col("package")).when(F.col("root").startswith("$"), F.col("known")).otherwise(F.col("root"))
    state = one.withColumn("type", start).withColumn("done", F.lit(0))
    longest = found.agg(F.max(F.size("steps"))).first()[0] or 0
    for _ in range(longest):
        moved = state.join(dealt(reach), (F.col("type") == F.col("of")) & (F.get("steps", F.col("done")) == F.col("step")), "left").drop("of", "step")
        goes = F.col("done") < F.size("steps")
        state = moved.withColumn("type", F.when(goes, F.col("to")).otherwise(F.col("type"))).withColumn("done", F.when(goes, F.col("done") + 1).otherwise(F.col("done"))).drop("to")
    return state.select("file_id", "sub", "line", "chain", "root", "steps", "type")


def autoload_subs(rows: DataFrame) -> DataFrame:
    """file_id, line, name, package: subs behind the end mark of files that use AutoLoader."""
    using = uses(rows).where("kind = 'import' and name = 'AutoLoader'").select("file_id").distinct()
    subs = rows.where("data").select("file_id", "line", got("text", r"^\s*sub\s+(\w+)").alias("name"), "package").where("name is not null")
    return subs.join(dealt(using), "file_id", "left_semi")


def assemble(found: list[DataFrame]) -> DataFrame:
    """file_id, n_symbols, n_references, n_imports, names (sorted) of the events of a file, whatever pack found them."""
    rows = reduce(DataFrame.unionByName, found)
    n = lambda p: F.count(F.when(F.col("capture").startswith(p), 1))
    names = F.array_sort(F.collect_set(F.when(F.col("capture").startswith("def."), F.col("name"))))
    return rows.groupBy("file_id").agg(n("def.").alias("n_symbols"), n("ref.").alias("n_references"), n("import").alias("n_imports"), names.alias("names"))
