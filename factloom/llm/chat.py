"""Chat formatting by a finite-state machine, in DataFrame functions only.

A template declares the mark of each role, the mark that ends a turn, which roles may follow which, and whose texts are
learned from. The machine's state is the role of the turn before (or start); a turn moves it to its own role, which is legal
where the template's table has that move. Each move emits three segments (opening mark, escaped text, closing mark), of
which only the text carries the loss flag, and only where the state moved to is a learned one. A move that the table lacks
is emitted all the same, counted, and makes the conversation invalid; the machine goes on from the role it reached.
Escapes leave no mark inside a text: a backslash doubles, and the first letter of a would-be mark turns into a backslash
and a stand-in letter.

Defined results: rows go by turn, then role and text (ties and repeated rows stay, in that order; null turns first); null
text and null role are empty strings; a role that the template lacks is formatted under a mark of its own, and no move
leads to it or from it. Rows without a conv_id are one conversation. Extra columns are ignored. An empty table gives no
conversations. A conversation is one value of the result, so its turns meet in one row; time and memory are linear in it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """Marks, allowed successions (state to roles; a state is the last role, or start) and the learned roles."""

    marks: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: str = "### ?{role}: "
    end: str = "</turn>\n"
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    learned: tuple[str, ...] = ("assistant",)
    #: What may not stand inside a text: (pattern of a mark's first letter, its stand-in).
    escapes: tuple[tuple[str, str, str], ...] = (("#(?=##)", "#", "h"), ("<(?=/turn>)", "<", "l"))


DEFAULT = Template()


def escape(text: Column, t: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for pattern, _, stand_in in t.escapes:
        out = F.regexp_replace(out, pattern, "\\\\" + stand_in)
    return out


def unescape(text: Column, t: Template) -> Column:
    """Inverse of ``escape``: what lies between doubled backslashes has single escapes only."""

    def plain(x: Column) -> Column:
        for _, letter, stand_in in t.escapes:
            x = F.replace(x, F.lit("\\" + stand_in), F.lit(letter))
        return x

    return F.array_join(F.transform(F.split(text, "\\\\\\\\"), plain), "\\")


def _mark(role: Column, t: Template) -> Column:
    before, after = t.other.split("{role}")
    out = F.concat(F.lit(before), F.url_encode(role), F.lit(after))
    for name, mark in t.marks.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def moves(turns: Column, t: Template) -> Column:
    """array<struct<role, text, state, legal>>: each turn with the state that it finds and whether the table has its move."""
    table = [f"{state}\n{role}" for state, roles in t.follows.items() for role in roles]
    state = lambda i: F.when(i == 0, F.lit("start")).otherwise(F.get(turns, i - 1)["role"])
    found = F.transform(turns, lambda x, i: F.struct(x["role"].alias("role"), x["text"].alias("text"), state(i).alias("state")))
    return F.transform(found, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), x["state"].alias("state"), F.concat(x["state"], F.lit("\n"), x["role"]).isin(*table).alias("legal")))


def format_chats(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, n_turns, formatted, segments (text, loss), n_illegal, valid, for each conversation of turns (conv_id, turn, role, text)."""
    t = template
    row = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    talks = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns")).withColumn("moves", moves(F.col("turns"), t))

    def emitted(x: Column) -> Column:
        segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(segment(_mark(x["role"], t), F.lit(False)), segment(escape(x["text"], t), x["role"].isin(*t.learned)), segment(F.lit(t.end), F.lit(False)))

    n_illegal = F.aggregate("moves", F.lit(0).cast("long"), lambda n, x: n + F.when(x["legal"], 0).otherwise(1))
    talks = talks.select("conv_id", F.size("moves").cast("long").alias("n_turns"), F.flatten(F.transform("moves", emitted)).alias("segments"), n_illegal.alias("n_illegal"))
    return talks.select("conv_id", "n_turns", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "n_illegal", (F.col("n_illegal") == 0).alias("valid"))


def read_chats(formatted: Column, template: Template = DEFAULT) -> Column:
    """array<struct<role, text>> parsed back from a formatted conversation; the closing mark can stand nowhere else."""
    t = template
    before, after = t.other.split("{role}")

    def turn(x: Column) -> Column:
        colon = F.locate(after, x)
        role = F.url_decode(x.substr(F.lit(len(before) + 1), colon - (len(before) + 1)))
        text = x.substr(colon + len(after), F.length(x))
        for name, mark in t.marks.items():
            role, text = F.when(x.startswith(mark), F.lit(name)).otherwise(role), F.when(x.startswith(mark), x.substr(F.lit(len(mark) + 1), F.length(x))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text, t).alias("text"))

    return F.transform(F.filter(F.split(formatted, t.end), lambda x: x != ""), turn)


def learned_text(segments: Column, template: Template = DEFAULT) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
