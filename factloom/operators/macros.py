"""Macros of C: what a text becomes when its macros are replaced, and where each place of the result comes from.

Files (file_id, path, text) become rows of tokens; conditions, brackets, definitions and includes are windows and joins over
those rows, and a file takes from the headers that it reaches only the macros that it uses, directly or through the bodies of
others. Only the replacement of one use is Python: a token remembers which macros made it (its hide set), and is not replaced
by them again, so that mutually recursive macros end.

A definition holds from its line to the next ``#define`` or ``#undef`` of its name. Macros of headers hold from the top of
the file; of several headers the nearest wins, then the smaller path. Conditions are judged by the declared configuration in
three values, and only what is false is left out. Names in comments, literals and directives stay. A use whose brackets never
close stays, and so does one whose replacement would pass LONGEST tokens: it is a row with too_long and its own text. A name
that only appears when a macro is replaced takes its arguments from the replacement, not from the text behind it.
Offsets count code points. Null texts and files without macros give no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.operators import spans as S
from factloom.operators.graph import closure, cut, dealt, kept

LONGEST = 20_000
#: Directives with what continues them, comments, literals, numbers, names, blanks, single characters; read alike by Java and Python.
DIRECTIVE = r"(?m:^)[ \t]*+#(?:[^\n\\/]++|\\\r?\n|\\[\s\S]|/\*[\s\S]*?\*/|/)*+"
WITHIN = "|".join((
    r"//(?:[^\n\\]++|\\[\s\S])*+", r"/\*[\s\S]*?(?:\*/|(?![\s\S]))",
    r'R"([^()\\\s]{0,16})\([\s\S]*?\)\1"', r'"(?:[^"\\\n]++|\\[\s\S])*+"?', r"'(?:[^'\\\n]++|\\[\s\S])*+'?",
    r"\.?[0-9](?:[eEpP][+-]|'?[0-9A-Za-z_.])*+", r"[A-Za-z_][A-Za-z_0-9]*+", r"[^\S\n]++", r"##", r"[\s\S]",
))
TOKEN = f"{DIRECTIVE}|{WITHIN}"
NAME = r"^[A-Za-z_]\w*$"
BLANK = r"^(\s|//|/\*)"
_MACRO = "struct<params:array<string>,body:string>"


def tokens(files: DataFrame) -> DataFrame:
    """file_id, i, text, at, kind (directive, blank, name, other): every token of every file, in order."""
    each = files.select("file_id", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("i", "text"))
    before = Window.partitionBy("file_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("text")
    kind = F.when(t.rlike(r"^[ \t]*#") & (F.length(t) > 1) & (t != "##"), "directive").when(t.rlike(BLANK), "blank").when(t.rlike(NAME), "name").otherwise("other")
    return each.select("file_id", "i", "text", F.coalesce(F.sum(F.length(t)).over(before), F.lit(0)).alias("at"), kind.alias("kind"))


def directives(toks: DataFrame) -> DataFrame:
    """file_id, i, at, word, rest: each directive, without comments and line breaks."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", r"\\\r?\n", " "), r"/\*[\s\S]*?\*/|//.*", " "))
    word = F.regexp_extract(plain, r"^#\s*(\w+)", 1)
    return toks.where("kind = 'directive'").select("file_id", "i", "at", word.alias("word"), F.trim(F.regexp_replace(plain, r"^#\s*\w*", "")).alias("rest"))


def dead(found: DataFrame, known: Mapping[str, bool]) -> DataFrame:
    """file_id, i, until: where a branch begins that the configuration rules out, and the place where it ends (null: with the file)."""
    c = found.where(F.col("word").isin("if", "ifdef", "ifndef", "elif", "else", "endif"))
    opens = F.col("word").startswith("if")
    inside = Window.partitionBy("file_id").orderBy("i")
    c = c.withColumn("level", F.sum(F.when(opens, 1).when(F.col("word") == "endif", -1).otherwise(0)).over(inside) + F.when(F.col("word") == "endif", 1).otherwise(0))
    level = Window.partitionBy("file_id", "level").orderBy("i")
    c = c.withColumn("chain", F.sum(opens.cast("int")).over(level)).withColumn("until", F.lead("at").over(level))
    says = F.lit(None).cast("boolean")
    name = F.regexp_extract("rest", r"^(?:!\s*)?(?:defined\s*\(?\s*)?(\w+)\s*\)?$", 1)
    for value in (True, False):
        names = [n for n, v in known.items() if v == value]
        says = F.when(name.isin(*names), value).otherwise(says) if names else says
    asked = F.col("rest").rlike(r"^(!\s*)?defined\b")
    own = (F.when(F.col("word") == "else", True).when(F.col("word") == "ifdef", says).when(F.col("word") == "ifndef", ~says)
           .when(F.col("rest") == "0", False).when(F.col("rest") == "1", True).when(asked, F.when(F.col("rest").startswith("!"), ~says).otherwise(says)))
    chain = Window.partitionBy("file_id", "level", "chain").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("own", own).withColumn("taken", F.coalesce(F.max(F.coalesce("own", F.lit(False))).over(chain), F.lit(False)))
    return c.where("word <> 'endif' and (taken or own = false)").select("file_id", "i", "until")


def live(toks: DataFrame, known: Mapping[str, bool]) -> DataFrame:
    """The tokens outside of branches that the configuration rules out."""
    ruled = dead(directives(toks), known).select("file_id", "i", F.coalesce("until", F.lit(1 << 60)).alias("until"))
    both = toks.withColumn("until", F.lit(None).cast("long")).unionByName(ruled, allowMissingColumns=True)
    w = Window.partitionBy("file_id").orderBy("i").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("until", F.coalesce(F.max("until").over(w), F.lit(-1))).where("kind is not null and at >= until").drop("until")


def definitions(alive: DataFrame) -> DataFrame:
    """file_id, name, at, macro (null: undefined from here on): what the directives of a file define, in order."""
    d = directives(alive).where(F.col("word").isin("define", "undef"))
    params = F.regexp_extract("rest", r"^\w+\(([^)]*)\)", 1)
    with_params = F.col("rest").rlike(r"^\w+\(")
    names = F.when(with_params, F.filter(F.transform(F.split(params, ","), lambda x: F.trim(x)), lambda x: x != ""))
    body = F.trim(F.regexp_replace("rest", r"^\w+(\([^)]*\))?", ""))
    macro = F.when(F.col("word") == "define", F.struct(names.alias("params"), body.alias("body"))).cast(_MACRO)
    return d.select("file_id", F.regexp_extract("rest", r"^(\w+)", 1).alias("name"), "at", macro.alias("macro")).where("name <> ''")


def includes(alive: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst: which file takes in which, by the path beside it or the path itself."""
    at = directives(alive).where("word = 'include'").select("file_id", F.regexp_extract("rest", r'^["<]([^">]+)[">]', 1).alias("wanted"))
    beside = at.join(files.select("file_id", F.regexp_extract("path", r"^(.*/)?[^/]*$", 1).alias("folder")), "file_id")
    tried = beside.select("file_id", "wanted", F.posexplode(F.array(F.concat("folder", "wanted"), F.col("wanted"))).alias("rank", "path"))
    hit = tried.join(files.select(F.col("file_id").alias("dst"), "path"), "path")
    return hit.groupBy(F.col("file_id").alias("src"), "wanted").agg(F.min_by("dst", "rank").alias("dst")).select("src", "dst").distinct()


def _names(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z_]\w*"), F.lit(0)))


def in_force(alive: DataFrame, defined: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, name, at, macro: the definitions of each file, and at -1 those that it uses of the headers that it reaches.

    What a file needs grows by the bodies of what it found, in rounds, until nothing is new.
    """
    steps = cut(includes(alive, files))
    if steps.isEmpty():
        return defined
    reach = closure(steps, steps.select(F.col("src").alias("origin")).distinct()).where("node <> origin").select(F.col("origin").alias("file_id"), F.col("node").alias("header"), "depth")
    last = defined.groupBy(F.col("file_id").alias("header"), "name").agg(F.max_by(F.struct("macro"), "at").alias("x"))  # in a struct, as an undefined one is null
    last = last.where("x.macro is not null").select("header", "name", "x.macro").join(dealt(files.select(F.col("file_id").alias("header"), "path")), "header")
    # what a file can see, by the headers that it reaches: a name alone would meet the definitions of all other files
    visible = kept(reach.join(dealt(last), "header").select("file_id", "name", "depth", "path", "macro"))
    own = alive.where("kind = 'name'").select("file_id", F.col("text").alias("name")).unionByName(defined.select("file_id", F.explode(_names(F.col("macro.body"))).alias("name")))
    need = seen = kept(own.distinct().join(dealt(visible.select("file_id", "name").distinct()), ["file_id", "name"], "left_semi"))
    found = None
    while True:
        hit = need.join(dealt(visible), ["file_id", "name"]).groupBy("file_id", "name").agg(F.min_by("macro", F.struct("depth", "path")).alias("macro"))
        hit = cut(hit)
        found = hit if found is None else found.unionByName(hit)
        need = cut(hit.select("file_id", F.explode(_names(F.col("macro.body"))).alias("name")).distinct().join(dealt(seen), ["file_id", "name"], "left_anti"))
        if need.isEmpty():
            return defined.unionByName(found.select("file_id", "name", F.lit(-1).cast("long").alias("at"), "macro"))
        seen = seen.unionByName(need)


def uses(alive: DataFrame, defined: DataFrame) -> DataFrame:
    """file_id, at, end, call_end (null: no closed brackets follow): the names that may be macros."""
    t = alive.where("kind in ('name', 'other')")
    w = Window.partitionBy("file_id").orderBy("i")
    step = F.when(F.col("text") == "(", 1).when(F.col("text") == ")", -1).otherwise(0)
    t = t.withColumn("next", F.lead(F.struct("i", "text")).over(w)).withColumn("level", F.sum(step).over(w) + (F.col("text") == ")").cast("int"))
    after = F.lead(F.struct("text", "at")).over(Window.partitionBy("file_id", "level").orderBy("i"))
    closes = t.where("text in ('(', ')')").withColumn("after", after).where("text = '(' and after.text = ')'").select("file_id", F.col("i").alias("open"), (F.col("after.at") + 1).alias("call_end"))
    named = t.where("kind = 'name'").withColumn("name", F.col("text")).join(dealt(defined.select("file_id", "name").distinct()), ["file_id", "name"], "left_semi")
    named = named.select("file_id", "at", (F.col("at") + F.length("text")).alias("end"), F.when(F.col("next.text") == "(", F.col("next.i")).alias("open"))
    return named.join(dealt(closes), ["file_id", "open"], "left").select("file_id", "at", "end", "call_end")


class _TooLong(Exception):
    pass


class _Token:
    """A token of a replacement: where it comes from, whether it stands there as it is, and the macros that made it."""

    __slots__ = ("text", "origin", "exact", "hide")

    def __init__(self, text: str, origin: int, exact: bool = False, hide: frozenset = frozenset()):
        self.text, self.origin, self.exact, self.hide = text, origin, exact, hide


def _read(text: str, origin: int, exact: bool) -> list[_Token]:
    return [_Token(m[0], origin + m.start() if exact else origin, exact) for m in re.finditer(WITHIN, text)]


def _blank(t: _Token) -> bool:
    return re.match(BLANK, t.text) is not None


def _trimmed(ts: list[_Token]) -> list[_Token]:
    full = [k for k, t in enumerate(ts) if not _blank(t)]
    return ts[full[0]:full[-1] + 1] if full else []


def _arguments(todo: deque) -> tuple[list[list[_Token]], int, frozenset] | None:
    """The arguments at the front of todo, how many tokens they take, and the hide set of the closing bracket."""
    depth, args = 0, [[]]
    for k, t in enumerate(todo):
        if depth == 0 and t.text != "(":
            if _blank(t):
                continue
            return None
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0:
            return [_trimmed(a) for a in args], k + 1, t.hide
        if t.text == "," and depth == 1:
            args.append([])
        elif not (t.text == "(" and depth == 1):
            args[-1].append(t)
    return None


def _bound(params: list[str], args: list[list[_Token]]) -> dict[str, list[_Token]]:
    """Arguments by parameter; what is too many goes to the variable part, what is missing is empty."""
    out = {}
    for k, p in enumerate(params):
        if p.endswith("..."):
            rest = args[k:]
            joined = [t for j, a in enumerate(rest) for t in ([_Token(",", a[0].origin if a else 0), _Token(" ", 0)] if j else []) + a]
            out[p[:-3].strip() or "__VA_ARGS__"] = joined
        else:
            out[p] = args[k] if k < len(args) else []
    return out


def _filled(body: list[_Token], bound: dict[str, list[_Token]], hide: frozenset, macros, budget: list[int]) -> list[_Token]:
    """A body with its arguments: as they are beside ``##``, as a literal behind ``#``, else with their own macros replaced."""
    out: list[_Token] = []
    k = 0
    while k < len(body):
        t = body[k]
        ahead = next((j for j in range(k + 1, len(body)) if not _blank(body[j])), None)
        if t.text == "#" and bound and ahead is not None and body[ahead].text in bound:
            text = "".join(" " if _blank(a) else a.text for a in bound[body[ahead].text])
            out.append(_Token('"' + re.sub(r'(["\\])', r"\\\1", text) + '"', t.origin))
            k = ahead + 1
            continue
        if t.text == "##" and out and ahead is not None:
            while out and _blank(out[-1]):
                out.pop()
            right = bound.get(body[ahead].text, [body[ahead]])
            if out and right:
                left = out.pop()
                out.append(_Token(left.text + right[0].text, t.origin, False, left.hide & right[0].hide))
            out += right[1:] if out and right else right
            k = ahead + 1
            continue
        raw = ahead is not None and body[ahead].text == "##"
        out += (bound[t.text] if raw else _replaced(bound[t.text], macros, budget)) if t.text in bound else [t]
        k += 1
    return [_Token(t.text, t.origin, t.exact, t.hide | hide) for t in out]


def _replaced(ts: list[_Token], macros, budget: list[int]) -> list[_Token]:
    out, todo = [], deque(ts)
    while todo:
        t = todo.popleft()
        macro = macros(t.text) if t.text not in t.hide else None
        bound, hide = {}, t.hide
        if macro is not None and macro["params"] is not None:
            call = _arguments(todo)
            if call is None:
                macro = None
            else:
                bound, hide = _bound(list(macro["params"]), call[0]), t.hide & call[2]
                for _ in range(call[1]):
                    todo.popleft()
        if macro is None:
            out.append(t)
            continue
        made = _filled(_read(macro["body"], t.origin, False), bound, hide | {t.text}, macros, budget)
        budget[0] -= len(made) + 1
        if budget[0] < 0:
            raise _TooLong
        todo.extendleft(reversed(made))
    return out


def _splices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for file_id, text, sites, events in zip(batch["file_id"], batch["text"], batch["uses"], batch["events"]):
            history: dict[str, list] = {}
            for e in sorted(events, key=lambda e: e["at"]):
                history.setdefault(e["name"], []).append(e)
            stop = 0
            for s in sorted(sites, key=lambda s: s["at"]):
                at = s["at"]
                if at < stop:  # an argument of the use before
                    continue

                def macros(name: str, at: int = at):
                    own = history.get(name)
                    k = bisect_right(own, at, key=lambda e: e["at"]) if own else 0
                    return own[k - 1]["macro"] if k else None

                name, macro = text[at:s["end"]], macros(text[at:s["end"]])
                end = s["end"] if macro is not None and macro["params"] is None else s["call_end"]
                if macro is None or end is None or pd.isna(end):
                    continue
                stop = end = int(end)
                try:
                    made = _replaced(_read(text[at:end], at, True), macros, [LONGEST])
                except _TooLong:
                    rows.append((file_id, at, end, name, text[at:end], True, [{"text": text[at:end], "origin": at, "exact": True}]))
                    continue
                made = [t for t in made if t.text]
                rows.append((file_id, at, end, name, "".join(t.text for t in made), False, [{"text": t.text, "origin": t.origin, "exact": t.exact} for t in made]))
        yield pd.DataFrame(rows, columns=["file_id", "start", "end", "name", "text", "too_long", "pieces"])


def splices(files: DataFrame, known: Mapping[str, bool] | None = None) -> DataFrame:
    """file_id, start, end, name, text, too_long, pieces (text, origin, exact): what takes the place of each use of a macro.

    known tells which names the configuration defines and which it doesn't; other conditions are open and keep all branches.
    """
    files = files.select("file_id", "path", "text")
    alive = kept(live(kept(tokens(files)), known or {}))
    defined = kept(in_force(alive, kept(definitions(alive)), files))
    sites = uses(alive, defined).groupBy("file_id").agg(F.collect_list(F.struct("at", "end", "call_end")).alias("uses"))
    events = defined.groupBy("file_id").agg(F.collect_list(F.struct("name", "at", "macro")).alias("events"))
    whole = files.select("file_id", "text").join(dealt(sites), "file_id").join(dealt(events), "file_id")
    kind = dict(files.dtypes)["file_id"]
    return whole.mapInPandas(_splices, f"file_id {kind}, start long, end long, name string, text string, too_long boolean, pieces array<struct<text:string,origin:long,exact:boolean>>")


def applied(files: DataFrame, made: DataFrame) -> DataFrame:
    """file_id, text: each file with its splices in place; files without splices as they are."""
    per = made.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("text").alias("new")))).alias("s"))
    n = F.size("s")
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.try_element_at("s", i)["end"])
    part = F.transform("s", lambda s, i: F.concat(F.col("text").substr((before(i) + 1).cast("int"), (s["start"] - before(i)).cast("int")), s["new"]))
    end = F.element_at("s", -1)["end"]
    tail = F.col("text").substr((end + 1).cast("int"), F.length("text"))
    both = files.select("file_id", "text").join(dealt(per), "file_id", "left")
    return both.select("file_id", F.when(n > 0, F.concat(F.array_join(part, ""), tail)).otherwise(F.col("text")).alias("text"))


def anchors(made: DataFrame) -> DataFrame:
    """file_id, pos, anchor (pos, origin, exact): from pos in the result on, up to the next anchor, offsets lead back to origin."""
    shift = F.sum(F.length("text") - (F.col("end") - F.col("start"))).over(Window.partitionBy("file_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    s = made.withColumn("out", F.col("start") + F.coalesce(shift, F.lit(0)))
    ends = s.select("file_id", (F.col("out") + F.length("text")).alias("pos"), F.col("end").alias("origin"), F.lit(True).alias("exact"), F.struct(F.col("end").alias("at"), F.lit(-1).alias("k")).alias("rank"))
    p = s.select("file_id", "out", "start", F.posexplode("pieces").alias("k", "p"))
    before = Window.partitionBy("file_id", "start").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    inner = p.select("file_id", (F.col("out") + F.coalesce(F.sum(F.length("p.text")).over(before), F.lit(0))).alias("pos"), "p.origin", "p.exact", F.struct(F.col("start").alias("at"), "k").alias("rank"))
    return inner.unionByName(ends).groupBy("file_id", "pos").agg(F.max_by(F.struct("pos", "origin", "exact"), "rank").alias("anchor"))


def origins(points: DataFrame, made: DataFrame) -> DataFrame:
    """points (file_id, pos, …) of the result with original, the offset in the text before; several maps compose by repeating this."""
    at = S.as_of(points, anchors(made), ["file_id"], ["pos"], "anchor")
    exact = F.col("anchor.origin") + F.col("pos") - F.col("anchor.pos")
    original = F.when(F.col("anchor").isNull(), F.col("pos")).when(F.col("anchor.exact"), exact).otherwise(F.col("anchor.origin"))
    return at.withColumn("original", original).drop("anchor")
