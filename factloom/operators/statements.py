"""Statements of Perl source text, with the scopes in which they stand.

A file is read once, letter by letter where it matters: quote-like operators with their delimiters, here-documents,
documentation and comments are told apart from code, brackets are kept on a stack, and tokens are folded into statements.
A block's opening ends a statement, and so does its closing, so that a statement has no block within it; a hash, a
subscript or the block of a map stays inside. A construct spread over lines is one statement, and several statements of a
line are several rows. Each file is independent of all others, so that nothing is shuffled.

Rows (of a file in the order of ``at``): line and end_line; kind (code, comment, pod, mark, data); text (without comments,
blanks before it so that columns hold, line breaks as blanks); norm (text with strings that hold no variables in single
quotes and word lists as lists of strings); code (text with strings emptied); opens and closes (braces), ends (whether it
closes a block) and opened (the line where that began); depth (braces open before it) and deepest (of the file); package,
sub and sub_line of the scope; data (behind the end mark); vars (name, line, col of each variable, those in strings too); head (norm of what opened the innermost block).

Defined results: null and empty texts have no rows; quotes and brackets that never close count as plain signs; a
closing bracket without an opening one is passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
#: Fixed values of the language: quote-like operators (and how many parts they have), words before a block, words before a pattern.
QUOTES = {"q": 1, "qq": 1, "qw": 1, "qr": 1, "qx": 1, "m": 1, "s": 2, "tr": 2, "y": 2}
CONDITIONS = {"if", "elsif", "unless", "while", "until", "for", "foreach", "given", "when", "catch"}
BLOCK_WORDS = {"else", "continue", "do", "eval", "try", "finally", "default", "BEGIN", "END", "INIT", "CHECK", "UNITCHECK", "ADJUST"}
NAMED = {"sub", "method", "package", "class", "role"}
BEFORE_PATTERN = {"split", "grep", "map", "if", "unless", "while", "until", "and", "or", "not", "return", "push", "join", "x", "lt", "gt", "le", "ge", "eq", "ne", "cmp", "elsif", "when"}

_WORD = re.compile(r"[A-Za-z_]\w*(?:::\w+)*(?:::)?")
_SCALAR = re.compile(r"\$#?\$*(?:::)?[A-Za-z_]\w*(?:::\w+)*|\$\d+|\$\^\w|\$\](?=\s*[<>=!])|\$[&`'+!@/\\,.\"<>?|:$-](?!\w)|@\$*(?:::)?[A-Za-z_]\w*(?:::\w+)*|@[-+](?=[;,\s)])")
_OTHER_SIGIL = re.compile(r"[%&*]\$*(?:::)?[A-Za-z_]\w*(?:::\w+)*|%[+!](?=\s*[;,)])")
_NUMBER = re.compile(r"0[xXbB][\da-fA-F_]+|\d[\d_]*(?:\.(?!\.)[\d_]*)?(?:[eE][+-]?\d+)?")
_HEREDOC = re.compile(r"<<(~?)(?:\s*\"([^\"\n]*)\"|\s*'([^'\n]*)'|([A-Za-z_]\w*))")
_FILETEST = re.compile(r"-[a-zA-Z](?!\w|\s*=>)")
_READLINE = re.compile(r"<\$?\w*>")
_OPERATOR = re.compile(r"->|=>|\+\+|--|\*\*=?|=~|!~|<=>|[=!<>]=|&&=?|\|\|=?|//=?|\.\.\.?|<<|>>|[-+*/.%&|^]=|.", re.S)
_POD = re.compile(r"=[a-zA-Z]\w*")
_POD_END = re.compile(r"^=cut\b.*\n?", re.M)
_MARK = re.compile(r"__(?:END|DATA)__[ \t\r]*(?:\n|\Z)")
_PROTOTYPE = re.compile(r"\s*\(([$@%&*;\\\[\]+_ ]*)\)")
_ARROWED, _CLOSED, _BLANKS, _FLAGS = (re.compile(p) for p in (r"\s*=>", r"\s*\}", r"\s*", r"\w*"))
_IN_STRING = re.compile(r"(?<!\\)(?:\\\\)*([$@][A-Za-z_]\w*)")

FIELDS = "at int, line int, end_line int, kind string, text string, norm string, code string, opens int, closes int, ends int, opened int, depth int, deepest int, package string, sub string, sub_line int, data boolean, vars array<struct<name:string,line:int,col:int>>, head string"
_ARROW = pa.schema([("at", pa.int32()), ("line", pa.int32()), ("end_line", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("norm", pa.string()), ("code", pa.string()), ("opens", pa.int32()), ("closes", pa.int32()), ("ends", pa.int32()), ("opened", pa.int32()), ("depth", pa.int32()), ("deepest", pa.int32()), ("package", pa.string()), ("sub", pa.string()), ("sub_line", pa.int32()), ("data", pa.bool_()), ("vars", pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32()), ("col", pa.int32())]))), ("head", pa.string())])


@dataclass(slots=True)
class Token:
    kind: str
    raw: str
    norm: str
    code: str
    line: int
    gap: str = ""


@dataclass
class Frame:
    """An open bracket; a block also keeps what held outside of it."""

    kind: str
    opened: int = 0
    outside: tuple = ()
    head: str | None = None
    after_sub: bool = False


@dataclass
class Row:
    depth: int
    scope: tuple
    head: str | None
    line: int
    col: int
    tokens: list[Token] = field(default_factory=list)
    vars: list[dict] = field(default_factory=list)
    ends: int = 0
    opened: int | None = None


def _quoted(content: str) -> str:
    return "'" + content.replace("'", "\\'") + "'"


class Reader:
    """One file's text, read from its start to its end."""

    def __init__(self, text: str):
        self.text, self.at, self.line, self.bol = text, 0, 0, 0
        self.frames: list[Frame] = []
        self.scope = ("main", None, None)  # package, sub, sub_line
        self.row: Row | None = None
        self.prev: Token | None = None
        self.heredocs: list[tuple[str, bool]] = []
        self.rows: list[dict] = []
        self.gap = ""

    # -- rows

    def depth(self) -> int:
        return sum(f.kind in ("block", "anon", "hash") for f in self.frames)

    def head(self) -> str | None:
        """What opened the innermost block."""
        return next((f.head for f in reversed(self.frames) if f.kind in ("block", "anon")), None)

    def inside(self) -> bool:
        """Whether a bracket is open that belongs to the current statement."""
        return bool(self.frames) and self.frames[-1].kind not in ("block", "anon")

    def put(self, kind: str, raw: str, norm: str | None = None, code: str | None = None) -> Token:
        if self.row is None:
            self.row = Row(self.depth(), self.scope, self.head(), self.line, self.at - self.bol)
            self.gap = ""
        token = Token(kind, raw, raw if norm is None else norm, raw if code is None else code, self.line, self.gap)
        self.row.tokens.append(token)
        self.prev, self.gap = token, ""
        return token

    def advance(self, to: int) -> None:
        """Move on, counting lines."""
        n = self.text.count("\n", self.at, to)
        if n:
            self.line += n
            self.bol = self.text.rfind("\n", self.at, to) + 1
        self.at = to

    def flush(self) -> None:
        row, self.row, self.prev = self.row, None, None
        if row is None:
            return
        arrows = [t.raw == "->" for t in row.tokens]
        tight = [i > 0 and (a or arrows[i - 1]) for i, a in enumerate(arrows)]  # a chain of calls holds together
        gaps = ["" if close else t.gap for t, close in zip(row.tokens, tight, strict=True)]
        raw = "".join([t.gap + t.raw for t in row.tokens])
        norm, code = ("".join([g + x for g, x in zip(gaps, parts, strict=True)]) for parts in ([t.norm for t in row.tokens], [t.code for t in row.tokens]))
        kinds = [t.kind for t in row.tokens]
        opens, closes = kinds.count("{"), kinds.count("}")
        self.emit("code", row.line, row.tokens[-1].line + row.tokens[-1].raw.count("\n"), " " * row.col + raw.replace("\n", " "), norm, code, opens, closes, row.ends, row.opened, row.depth, row.scope, False, row.vars, row.head)

    def emit(self, kind, line, end_line, text, norm="", code="", opens=0, closes=0, ends=0, opened=None, depth=None, scope=None, data=False, found=(), head=None) -> None:
        package, sub, sub_line = scope or self.scope
        self.rows.append({"at": len(self.rows), "line": line, "end_line": end_line, "kind": kind, "text": text, "norm": norm, "code": code, "opens": opens, "closes": closes, "ends": ends, "opened": opened, "depth": self.depth() if depth is None else depth, "package": package, "sub": sub, "sub_line": sub_line, "data": data, "vars": list(found), "head": head})

    # -- what stands here

    def delimited(self, at: int) -> tuple[str, int] | None:
        """What stands between the delimiter at a place and its partner, and the place behind that; None if it never closes."""
        first, text = self.text[at], self.text
        last, nesting, i = PAIRS.get(first, first), 1, at + 1
        while i < len(text):
            c = text[i]
            if c == "\\":
                i += 1
            elif c == last:
                nesting -= 1
                if not nesting:
                    return text[at + 1 : i], i + 1
            elif c == first:
                nesting += 1
            i += 1
        return None

    def after_term(self) -> bool:
        """Whether an operator, not a term, is due here."""
        p = self.prev
        if p is None:
            return False
        return p.kind in ("var", "num", "str", "words", "pattern", ")", "]", "}") or p.kind == "word" and p.raw not in BEFORE_PATTERN

    def string(self, kind: str, content: str, end: int, plain: bool) -> None:
        """A string token, with the variables that it holds."""
        raw, at = self.text[self.at : end], self.at + self.text[self.at : end].find(content)
        free = plain or not _IN_STRING.search(content)
        token_line, bol = self.line, self.bol
        self.put(kind, raw, _quoted(content) if free and kind == "str" else raw, "''")
        if not free:
            for m in _IN_STRING.finditer(content):
                begin = at + m.start(1)
                n = self.text.count("\n", self.at, begin)
                self.row.vars.append({"name": m[1], "line": token_line + n, "col": begin - (self.text.rfind("\n", self.at, begin) + 1 if n else bol)})
        self.advance(end)

    def quote_like(self, word: str) -> bool:
        """Read a quote-like operator, if the word is one here."""
        p, end = self.prev, self.at + len(word)
        rest = _BLANKS.match(self.text, end).end()
        if rest >= len(self.text) or p is not None and (p.raw in ("->", "sub") or p.kind == "{" and self.text[rest] == "}"):
            return False
        c = self.text[rest]
        if c == "," and p is not None and p.raw in ("=~", "!~", "{", "("):
            c = "\0"  # a comma as delimiter
        if c in "=,;)" or c.isspace() or (c.isalnum() or c == "_") or c == "#" and rest > end:
            return False
        found = self.delimited(rest)
        if found is None:
            return False
        content, stop = found
        if c == "\0" and "\n" in content:
            return False
        if QUOTES[word] == 2:
            if c in PAIRS:
                second = _BLANKS.match(self.text, stop).end()
                found = self.delimited(second) if second < len(self.text) else None
            else:
                found = self.delimited(stop - 1)
            if found is None:
                return False
            stop = found[1]
        if word in ("m", "qr", "s", "tr", "y"):
            self.put("pattern", self.text[self.at : (stop := _FLAGS.match(self.text, stop).end())], None, "''")
            self.advance(stop)
        elif word == "qw":
            self.put("words", self.text[self.at : stop], "(" + ", ".join(map(_quoted, content.split())) + ")", "''")
            self.advance(stop)
        else:
            self.string("str", content, stop, word == "q")
        return True

    def pod(self) -> None:
        start, found = self.line, _POD_END.search(self.text, self.at)
        end = found.end() if found else len(self.text)
        text = self.text[self.at : end]
        self.advance(end)
        self.emit("pod", start, max(start, self.line - 1), text)

    def behind_mark(self) -> None:
        self.flush()
        start = self.line
        end = _MARK.match(self.text, self.at).end()
        self.emit("mark", start, start, self.text[self.at : end].rstrip())
        self.advance(end)
        self.frames = []
        self.scope = (self.scope[0], None, None)
        while self.at < len(self.text):
            if _POD.match(self.text, self.at):
                self.pod()
                continue
            end = self.text.find("\n", self.at) + 1 or len(self.text)
            text = self.text[self.at : end].rstrip("\n")
            self.emit("data", self.line, self.line, text, text, text, data=True)
            self.advance(end)

    def newline(self) -> None:
        self.advance(self.at + 1)
        self.gap = " "
        for word, indented in self.heredocs:
            while self.at < len(self.text):
                end = self.text.find("\n", self.at) + 1 or len(self.text)
                body = self.text[self.at : end].rstrip("\r\n")
                self.advance(end)
                if (body.lstrip() if indented else body) == word:
                    break
        self.heredocs = []

    # -- brackets

    def opens(self) -> None:
        """A brace: a block where the statement's head asks for one, else part of the statement."""
        head = self.row.tokens if self.row else []
        prev, first = self.prev, next((t.raw for t in head if t.kind == "word"), None)
        if prev is not None and prev.raw == "sub" or prev is not None and prev.kind == ")" and self.closed_after_sub:
            kind = "anon" if not (first in ("sub", "method") and not self.inside() and len(head) > 1 and head[1].kind == "word") else "block"
        elif prev is not None and prev.kind == "word" and prev.raw in BLOCK_WORDS and len(head) > 1 and head[0].raw not in NAMED:
            kind = "anon"
        elif self.inside():
            kind = "hash"
        elif not head or len(head) == 1 and first is not None and first.isupper():  # AUTOLOAD, DESTROY and such go without sub
            kind = "block"
        elif head[0].kind == "word" and (first in NAMED and len(head) > 1 or first in CONDITIONS and prev.kind == ")" or first in BLOCK_WORDS and len(head) == 1):
            kind = "block"
        else:
            kind = "hash"
        line = self.row.line if self.row else self.line
        if kind != "hash":
            outside, name = self.scope, head[1].raw if len(head) > 1 and head[1].kind == "word" else None
            if kind == "block" and len(head) == 1 and first is not None and first.isupper() and first not in BLOCK_WORDS:
                self.scope = (self.scope[0], first, line)
            elif kind == "block" and first in ("sub", "method") and name:
                self.scope = (self.scope[0], name.rsplit("::", 1)[-1], line)
            elif kind == "block" and first in ("package", "class", "role") and name:
                self.scope = (name, None, None)
            if self.row is not None:
                self.row.scope = self.scope
        self.put("{", "{")
        if kind != "hash":
            if len(self.row.tokens) == 1:
                self.row.scope = self.scope
            self.flush()
            self.frames.append(Frame(kind, line, outside, self.rows[-1]["norm"]))
        else:
            self.frames.append(Frame("hash"))
        self.advance(self.at + 1)

    def closes(self) -> None:
        while self.frames and self.frames[-1].kind in ("(", "["):
            self.frames.pop()
        if not self.frames:
            return self.advance(self.at + 1)
        frame = self.frames[-1]
        if frame.kind == "hash":
            self.frames.pop()
            self.put("}", "}")
            return self.advance(self.at + 1)
        self.flush()
        self.put("}", "}")
        self.row.ends, self.row.opened = 1, frame.opened
        self.frames.pop()
        self.scope = frame.outside
        self.advance(self.at + 1)
        if frame.kind == "block":
            self.flush()

    # -- the walk

    closed_after_sub = False

    def read(self) -> list[dict]:
        text = self.text
        while self.at < len(text):
            c = text[self.at]
            if c == "\n":
                self.newline()
            elif c.isspace():
                end = self.at + 1
                while end < len(text) and text[end].isspace() and text[end] != "\n":
                    end += 1
                self.gap = self.gap or text[self.at : end]
                self.at = end
            elif self.at == self.bol and c == "=" and self.row is None and _POD.match(text, self.at):
                self.pod()
            elif self.at == self.bol and c == "_" and self.row is None and _MARK.match(text, self.at):
                self.behind_mark()
            elif c == "#":
                end = text.find("\n", self.at)
                end = len(text) if end < 0 else end
                if self.row is None and not text[self.bol : self.at].strip():
                    self.emit("comment", self.line, self.line, text[self.bol : end])
                self.at = end
            else:
                self.token(c)
        self.flush()
        deepest = max((r["depth"] + r["opens"] for r in self.rows), default=0)
        for r in self.rows:
            r["deepest"] = deepest
        return self.rows

    def token(self, c: str) -> None:
        text, at = self.text, self.at
        if c in "$@" and (m := _SCALAR.match(text, at)) or c in "%&*" and not self.after_term() and (m := _OTHER_SIGIL.match(text, at)):
            col = at - self.bol
            self.put("var", m[0])
            self.row.vars.append({"name": m[0], "line": self.line, "col": col})
            self.at = m.end()
        elif m := _WORD.match(text, at):
            word = m[0]
            quoted = _ARROWED.match(text, m.end()) or self.prev is not None and self.prev.kind == "{" and self.inside() and _CLOSED.match(text, m.end())
            if word in QUOTES and not quoted and self.quote_like(word):
                return
            named = self.prev is not None and self.prev.raw in NAMED
            self.put("word", word)
            self.at = m.end()
            if (named or word == "sub") and (p := _PROTOTYPE.match(text, self.at)):
                self.put("proto", p[0], "", "")
                self.advance(p.end())
                self.prev = Token("word", "sub" if word == "sub" else word, "", "", self.line)
        elif c.isdigit() and (m := _NUMBER.match(text, at)):
            self.put("num", m[0])
            self.at = m.end()
        elif c in "'\"`" and (found := self.delimited(at)):
            self.string("str", *found, c == "'")
        elif c == "/" and not self.after_term() and (found := self.delimited(at)):
            end = _FLAGS.match(text, found[1]).end()
            self.put("pattern", text[at:end], None, "''")
            self.advance(end)
        elif c == "<" and (self.prev is None or self.prev.kind in ("word", "op", "(", "[", "{")) and (m := _HEREDOC.match(text, at)):
            self.put("str", m[0], "''", "''")
            self.heredocs.append((next(g for g in m.groups()[1:] if g is not None), bool(m[1])))
            self.at = m.end()
        elif c == "<" and not self.after_term() and (m := _READLINE.match(text, at)) or c == "-" and not self.after_term() and (m := _FILETEST.match(text, at)):
            self.put("word", m[0])
            self.at = m.end()
        elif c == "{":
            self.opens()
        elif c == "}":
            self.closes()
        elif c in "([":
            after_sub = c == "(" and self.prev is not None and (self.prev.raw == "sub" or self.row is not None and len(self.row.tokens) == 2 and self.row.tokens[0].raw in ("sub", "method"))
            self.put(c, c)
            self.frames.append(Frame(c, after_sub=after_sub))
            self.at += 1
        elif c in ")]":
            self.put(c, c)
            if self.frames and PAIRS.get(self.frames[-1].kind) == c:
                self.closed_after_sub = self.frames.pop().after_sub
            self.at += 1
        elif c == ":" and self.row is not None and len(self.row.tokens) == 1 and self.prev.kind == "word" and not self.inside() and text[at : at + 2] != "::" and self.prev.raw not in BLOCK_WORDS:
            self.row = self.prev = None  # a label
            self.at += 1
        elif c == ";" and not self.inside():
            self.put(c, c)
            head = [t.raw for t in self.row.tokens[:2]]
            if head[0] in ("package", "class", "role") and len(head) > 1:
                self.scope = self.row.scope = (head[1], None, None)
            self.at += 1
            self.flush()
        else:
            m = _OPERATOR.match(text, at)
            self.put("op", m[0])
            self.at = m.end()


#: Rows that are handed on at a time.
ROWS = 10_000


def _columns(rows: list[dict]) -> pa.RecordBatch:
    """rows by columns; the variables of all rows are one flat list, cut at offsets."""
    found = [v for r in rows for v in r["vars"]]
    offsets = pa.array(accumulate((len(r["vars"]) for r in rows), initial=0), pa.int32())
    kind = _ARROW.field("vars").type.value_type
    flat = pa.StructArray.from_arrays([pa.array([v[f.name] for v in found], f.type) for f in kind], fields=list(kind))
    arrays = [pa.ListArray.from_arrays(offsets, flat).cast(f.type) if f.name == "vars" else pa.array([r[f.name] for r in rows], f.type) for f in _ARROW]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def _read(batches: Iterator[pa.RecordBatch], rest: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held, of = [], []

        def rows() -> pa.RecordBatch:
            part = _columns(held)
            keep = [batch.column(c).take(pa.array(of)) for c in rest]
            return pa.RecordBatch.from_arrays([*keep, *part.columns], [*rest, *part.schema.names])

        for i, text in enumerate(batch.column("text")):
            for row in Reader(text.as_py() or "").read():
                held.append(row)
                of.append(i)
                if len(held) == ROWS:
                    yield rows()
                    held, of = [], []
        if held:
            yield rows()


def statements(sources: DataFrame) -> DataFrame:
    """The statements of each file of sources (text, others kept)."""
    rest = [c for c in sources.columns if c != "text"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sources.select(*rest).schema)
    return sources.select(*rest, "text").mapInArrow(lambda b: _read(b, rest), f"{kept}, {FIELDS}")


def _normal(batches: Iterator[pa.RecordBatch], rest: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ["\n".join(r["norm"] for r in Reader(t or "").read() if r["kind"] == "code") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], [*rest, "text"])


def normal_forms(sources: DataFrame) -> DataFrame:
    """sources with their text in normal form, a statement a line: what patterns of plugins are held against."""
    rest = [c for c in sources.columns if c != "text"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sources.select(*rest).schema)
    return sources.select(*rest, "text").mapInArrow(lambda b: _normal(b, rest), f"{kept}, text string")
