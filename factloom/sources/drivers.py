"""Languages as data sources: a driver declares what it claims and how a text becomes facts, and Spark reads through it.

``spark.read.format("factloom.source")`` reads a tree of source files with the drivers that are registered: the listing is
planned once, on file names alone; files are dealt into partitions of bounded bytes by their size; filters on language and
path are pushed down, so that files they rule out are never opened; and the stream reader takes the files that have
appeared or changed since its last offset. Files are read by the executors, so the tree has to lie where all of them reach
it by this path. For texts that are a table already (from any store that Spark reads) ``analyzed`` does the same with the
same drivers.

Rows: path, lang, at, line, kind, name, package, sub. Defined results: files that no driver claims go to the one which
takes unclaimed files, or are left out if there is none; a file larger than maxBytes, or one that isn't UTF-8, gives one row
of kind not-analysed; a file that has gone since the listing gives none; empty files and empty trees give none.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith

SCHEMA = "path string, lang string, at int, line int, kind string, name string, package string, sub string"
_ARROW = pa.schema([("path", pa.string()), ("lang", pa.string()), ("at", pa.int32()), ("line", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("package", pa.string()), ("sub", pa.string())])
FORMAT = "factloom.source"
#: Bytes of files in a partition, about; files beyond MAX_BYTES aren't analysed.
PARTITION_BYTES, MAX_BYTES = 16 << 20, 1 << 20

#: A fact: line, kind, name, package, sub.
Fact = tuple[int, str, str, str | None, str | None]


@dataclass(frozen=True)
class Driver:
    """A language: its name, the extensions and file names it claims, how finished it is, and what facts a text holds."""

    lang: str
    facts: Callable[[str], Iterator[Fact]]
    extensions: tuple[str, ...] = ()
    filenames: tuple[str, ...] = ()
    maturity: str = "experimental"
    takes_unclaimed: bool = False
    caps: frozenset[str] = field(default_factory=frozenset)


class Registry:
    """The drivers of a reader; no two may claim one extension or file name, and one at most takes unclaimed files."""

    def __init__(self, drivers: tuple[Driver, ...]):
        self.drivers = drivers
        self.by_extension: dict[str, Driver] = {}
        self.by_name: dict[str, Driver] = {}
        for d in drivers:
            for claimed, table in ((d.extensions, self.by_extension), (d.filenames, self.by_name)):
                for c in claimed:
                    if c in table:
                        raise ValueError(f"{c} is claimed by {table[c].lang} and by {d.lang}")
                    table[c] = d
        rest = [d for d in drivers if d.takes_unclaimed]
        if len(rest) > 1:
            raise ValueError("more than one driver takes unclaimed files")
        self.rest = rest[0] if rest else None

    def claims(self, path: str) -> Driver | None:
        """The driver of a file: by its whole name, then by its extension, then the one for unclaimed files."""
        name = path.rsplit("/", 1)[-1]
        _, dot, extension = name.rpartition(".")
        return self.by_name.get(name) or (self.by_extension.get(extension.lower()) if dot else None) or self.rest

    def rows(self, path: str, text: str | None, size: int, max_bytes: int = MAX_BYTES) -> list[tuple]:
        """The rows of one file."""
        driver = self.claims(path)
        if driver is None:
            return []
        if text is None or size > max_bytes:
            return [(path, driver.lang, 0, 0, "not-analysed", "too large" if size > max_bytes else "not UTF-8", None, None)]
        return [(path, driver.lang, i, *fact) for i, fact in enumerate(driver.facts(text))]


def perl_facts(text: str) -> Iterator[Fact]:
    """Packages, subs, imports and parents of Perl statements."""
    import re

    from factloom.operators.statements import Reader

    for r in Reader(text).read():
        if r["kind"] != "code":
            continue
        if m := re.match(r"(package|class|role|sub|method)\s+([\w:]+)", r["norm"]):
            yield r["line"], "package" if m[1] in ("package", "class", "role") else "sub", m[2].rsplit("::", 1)[-1] if m[1] in ("sub", "method") else m[2], r["package"], r["sub"]
        elif m := re.match(r"use\s+([A-Z][\w:]*)", r["norm"]):
            yield r["line"], "import", m[1], r["package"], r["sub"]
        elif re.match(r"use\s+(?:parent|base)\b|(?:extends|with)\b", r["norm"]):
            for name in re.findall(r"'([\w:]+)'", re.sub(r"\{[^{}]*\}", "", r["norm"])):
                yield r["line"], "parent", name, r["package"], r["sub"]


def packed_facts(lang: str) -> Callable[[str], Iterator[Fact]]:
    """Facts by the capture patterns that are declared for a language, a line at a time."""

    def facts(text: str) -> Iterator[Fact]:
        import re

        from factloom.operators.extract import PACKS

        pack = [(capture, re.compile(pattern)) for capture, pattern in PACKS[lang]]
        for number, line in enumerate(text.split("\n")):
            for capture, pattern in pack:
                for m in pattern.finditer(line):
                    yield number, capture, m[1], None, None

    return facts


PERL = Driver("perl", perl_facts, ("pm", "pl", "t"), maturity="supported", caps=frozenset({"statements", "scopes"}))
PYTHON = Driver("python", packed_facts("python"), ("py",))
CPP = Driver("cpp", packed_facts("cpp"), ("c", "h", "cc", "cpp", "hpp"))
R_LANG = Driver("r", packed_facts("r"), ("r",))
CMAKE = Driver("cmake", packed_facts("cmake"), ("cmake",), ("CMakeLists.txt",))
BUNDLED = Registry((PERL, PYTHON, CPP, R_LANG, CMAKE))


@dataclass
class Files(InputPartition):
    """Paths and sizes of the files of a partition."""

    files: list[tuple[str, int]]


def listed(root: str) -> list[tuple[str, int, int]]:
    """path, bytes and time of change (nanoseconds) of every file below a root, in order."""
    out = []
    for folder, _, names in os.walk(root):
        for name in names:
            path = os.path.join(folder, name)
            try:
                s = os.stat(path)
            except OSError:
                continue
            out.append((path, s.st_size, s.st_mtime_ns))
    return sorted(out)


def dealt(files: list[tuple[str, int]], options: dict) -> list[Files]:
    """Files in partitions of bounded bytes."""
    bound, out, size = int(options.get("partitionbytes", PARTITION_BYTES)), [[]], 0
    for path, n in files:
        if out[-1] and size + n > bound:
            out.append([])
            size = 0
        out[-1].append((path, n))
        size += n
    return [Files(x) for x in out]


def opened(files: list[tuple[str, int]], drivers: Registry, max_bytes: int) -> Iterator[tuple]:
    for path, size in files:
        text = None
        if size <= max_bytes:
            try:
                with open(path, "rb") as f:
                    text = f.read().decode("utf-8")
            except FileNotFoundError:
                continue
            except UnicodeDecodeError:
                pass
        yield from drivers.rows(path, text, size, max_bytes)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, drivers: Registry):
        self.options, self.drivers = {k.lower(): v for k, v in options.items()}, drivers
        self.tests: list[Callable[[str, str], bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on lang and path decide which files are opened; all others are left to Spark."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            at = {"path": 0, "lang": 1}.get(column)
            if at is None or not isinstance(f, (EqualTo, In, StringStartsWith)):
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append(lambda *x, at=at, v=f.value: x[at] == v)
            elif isinstance(f, In):
                self.tests.append(lambda *x, at=at, v=frozenset(f.value): x[at] in v)
            else:
                self.tests.append(lambda *x, at=at, v=f.value: x[at].startswith(v))

    def partitions(self) -> list[Files]:
        claimed = [(p, n, self.drivers.claims(p)) for p, n, _ in listed(self.options["path"])]
        return dealt([(p, n) for p, n, d in claimed if d is not None and all(t(p, d.lang) for t in self.tests)], self.options)

    def read(self, partition: Files) -> Iterator[tuple]:
        return opened(partition.files, self.drivers, int(self.options.get("maxbytes", MAX_BYTES)))


class _StreamReader(DataSourceStreamReader):
    """Batches of the files that changed between two offsets (time of change and path); executors read them, in partitions of bounded bytes."""

    def __init__(self, options: dict, drivers: Registry):
        self.options, self.drivers = {k.lower(): v for k, v in options.items()}, drivers

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        newest = max(((t, p) for p, _, t in listed(self.options["path"])), default=(-1, ""))
        return {"time": newest[0], "path": newest[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return dealt([(p, n) for p, n, t in listed(self.options["path"]) if low < (t, p) <= high], self.options)

    def read(self, partition: Files) -> Iterator[tuple]:
        return opened(partition.files, self.drivers, int(self.options.get("maxbytes", MAX_BYTES)))


def register(spark: SparkSession, drivers: Registry = BUNDLED, name: str = FORMAT) -> None:
    """Register a format that reads with these drivers."""
    short = name

    class SourceFormat(DataSource):
        @classmethod
        def name(cls) -> str:
            return short

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> _Reader:
            return _Reader(dict(self.options), drivers)

        def streamReader(self, schema) -> _StreamReader:
            return _StreamReader(dict(self.options), drivers)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceFormat)


def analyzed(sources: DataFrame, drivers: Registry = BUNDLED) -> DataFrame:
    """The rows of sources (path, text), by the same drivers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = drivers.rows(path or "", text or "", 0)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], _ARROW.names)

    return sources.select("path", "text").mapInArrow(read, SCHEMA)


def capabilities(drivers: Registry = BUNDLED) -> str:
    """What the drivers declare, as JSON."""
    return json.dumps([{"lang": d.lang, "extensions": d.extensions, "filenames": d.filenames, "maturity": d.maturity, "takes_unclaimed": d.takes_unclaimed, "caps": sorted(d.caps)} for d in drivers.drivers])


def write_tree(files: DataFrame, root: str) -> None:
    """Write files (path, text) below a root that all executors reach, each as it is."""

    def write(rows) -> None:
        for r in rows:
            target = os.path.join(root, r["path"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(f"{target}.part", "w", encoding="utf-8") as f:
                f.write(r["text"])
            os.replace(f"{target}.part", target)

    files.select("path", F.coalesce("text", F.lit("")).alias("text")).foreachPartition(write)
