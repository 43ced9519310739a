"""Removal of repeated passages of words by prefix-partitioned suffix trees.

A word goes if a window of LENGTH words covers it that also starts in a document with a smaller doc_id. The suffixes that
matter are those that begin a window. Each belongs to the group of its *variable-length prefix*: its words up to the end of
the window's anchor, the run of GRAM words with the smallest hash among those in the window. Equal windows have equal
prefixes, and neighbouring suffixes whose prefixes end at one anchor share their words, so that a group is shipped as
stretches of text instead of one window a suffix. Groups are dealt to tasks of bounded size.

Documents are written once, bucketed by batches of bounded size, which also announce their anchors, with the bytes of the different stretches under each; a prefix that one
document alone has needs no tree and is dropped. A task then builds the subtree of its suffixes: words are named by rank,
ranks of runs of 3, 9 and 27 words follow from each other, they sort the suffixes, and descending them gives the depth of
the node where neighbours part. The deep internal nodes, those of LENGTH words or more, are the repeats: their smallest
doc_id is the source, and neighbouring windows under such nodes make up the maximal repeats.

A prefix with more than HOT bytes of different stretches (a passage in very many documents) is lengthened to the whole window: its
group then is one node, of which only the smallest doc_id is needed. That is found by an aggregate which combines
before the shuffle, over each batch's distinct windows, so that no task holds such a group. Words and windows are compared
by hashes of 64 bits.

Defined results: null or empty text has no words; texts of fewer words than LENGTH lose nothing; a null doc_id comes after
all others and is no source; rows with the same doc_id are no sources for each other. Words are what stands between ASCII
blanks, unchanged. Very long texts are batches of their own. Other columns are carried along (columns of its own names, and
text_bytes and batch, are replaced). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from factloom.llm.common import bucketed, cut, give_back, mix, releasing, windows

#: Words of a window, and of the runs among which anchors are chosen.
LENGTH, GRAM = 50, 8
#: Bytes of text in a batch, and of stretches in a group, about.
BATCH_BYTES, GROUP_BYTES = 4 << 20, 8 << 20
#: Bytes of different stretches up to which a prefix's suffixes form a tree in one task.
HOT = GROUP_BYTES // 2
#: Buckets of the written table for each partition of the documents.
BUCKETS = 4
NO_DOC = np.int64(2**63 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text whose words are found at a time.
PIECE = 1 << 20


#: What words are told apart by: a number for each byte, and which bytes are blanks.
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _MULTIPLIER), np.full(n, _INVERSE)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


def run_hashes(letters: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each run of letters (numbers without pattern) from first to stop, by differences of running sums."""
    up, down = _powers(1 << max(len(letters), 1).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * up[: len(letters)])])
    return mix((sums[stop] - sums[first]) * down[first] + (stop - first).astype(np.uint64))


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, and its hash; a piece of the text that ends with a blank at a time."""
    raw, at, parts = np.frombuffer(text, np.uint8), 0, []
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw) and not _BLANK[raw[end - 1]]:
            blank = np.flatnonzero(_BLANK[raw[end : end + PIECE]])
            end = end + int(blank[0]) + 1 if len(blank) else min(end + PIECE, len(raw))
        piece = raw[at:end]
        edge = np.flatnonzero(np.diff(_BLANK[piece], prepend=True, append=True)).reshape(-1, 2)
        parts.append((edge[:, 0] + at, edge[:, 1] + at, run_hashes(_LETTERS[piece], edge[:, 0], edge[:, 1])))
        at = end
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Batch:
    """The documents of a batch in the order of their ids, their words, and the stretches of windows that share an anchor."""

    def __init__(self, table: pa.Table):
        ids, texts = table["doc_id"].to_pylist(), table["text_bytes"].to_pylist()
        keys = [(NO_DOC if d is None else d, t or b"") for d, t in zip(ids, texts, strict=True)]
        self.order = sorted(range(len(keys)), key=keys.__getitem__)
        self.docs = np.array([keys[i][0] for i in self.order], np.int64)
        self.texts = [keys[i][1] for i in self.order]
        self.text = b"\n".join(self.texts)
        self.begin, self.end, self.hashes = words_of(self.text)
        stops = np.cumsum([len(t) + 1 for t in self.texts])
        self.ends = np.searchsorted(self.begin, stops).astype(np.int64)  # of each document, in words
        runs = len(self.hashes) - LENGTH + 1
        if runs <= 0:
            self.first = self.size = self.owner = np.empty(0, np.int64)
            self.anchor = np.empty(0, np.uint64)
        else:
            self._stretches(runs)
        self.content = run_hashes(mix(self.hashes), self.first, self.first + self.size + LENGTH - 1) ^ self.anchor
        _, self.sample, self.number = np.unique(self.content, return_index=True, return_inverse=True)
        self.least = self.owner[self.sample]  # documents go by doc_id, so the first place has the smallest

    def _stretches(self, runs: int) -> None:
        h, width, span = windows(self.hashes, GRAM), 1, LENGTH - GRAM + 1
        while 2 * width <= span:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        h = np.minimum(h[: width - span], h[span - width :]) if width < span else h
        owner = np.searchsorted(self.ends, np.arange(runs), side="right")
        ok = self.ends[owner] - np.arange(runs) >= LENGTH
        start = ok.copy()
        start[1:] &= (h[1:] != h[:-1]) | ~ok[:-1] | (owner[1:] != owner[:-1])
        self.first = np.flatnonzero(start)
        stop = np.flatnonzero(ok & np.append(~ok[1:] | start[1:], True)) + 1
        self.size = stop - self.first
        self.anchor = h[self.first]
        self.owner = self.docs[owner[self.first]]

    def stretch(self, at: int) -> bytes:
        """The text of a stretch."""
        return self.text[self.begin[self.first[at]] : self.end[self.first[at] + self.size[at] + LENGTH - 2]]

    def under(self, anchors: np.ndarray) -> np.ndarray:
        """Numbers of the distinct stretches with one of the anchors."""
        return np.flatnonzero(np.isin(self.anchor[self.sample], anchors))

    def windows(self, anchors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All windows, or those under one of the anchors: where each begins, its document, and its hash."""
        mine = np.arange(len(self.anchor)) if anchors is None else np.flatnonzero(np.isin(self.anchor, anchors))
        size = self.size[mine]
        at = np.repeat(self.first[mine] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return at, np.repeat(self.owner[mine], size), run_hashes(mix(self.hashes), at, at + LENGTH)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


ANNOUNCED = "announced array<struct<anchor:bigint,bytes:bigint,several:boolean>>"


def _announced(table: pa.Table) -> pa.Array:
    """A batch's anchors, with the bytes of the different stretches under each, and whether several of its documents have it."""
    batch = Batch(table)
    anchors, of = np.unique(batch.anchor, return_inverse=True)
    at = batch.sample
    size = batch.end[batch.first[at] + batch.size[at] + LENGTH - 2] - batch.begin[batch.first[at]]
    size = np.bincount(of[at], size, len(anchors)).astype(np.int64)
    low, high = np.full(len(anchors), NO_DOC), np.full(len(anchors), np.iinfo(np.int64).min)
    np.minimum.at(low, of, batch.owner)
    np.maximum.at(high, of, batch.owner)
    return pa.StructArray.from_arrays([_signed(anchors), pa.array(size), pa.array(low < high)], ["anchor", "bytes", "several"])


def _deal(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows in numbered batches of about BATCH_BYTES of text; the first row of a batch announces its anchors."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0

    def batch() -> Iterator[pa.RecordBatch]:
        told = _announced(pa.Table.from_batches(held))
        for part in pa.Table.from_batches(held).to_batches():
            offsets = pa.array(np.minimum(np.arange(part.num_rows + 1), 1) * len(told), pa.int32())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, number)), pa.ListArray.from_arrays(offsets, told)], [*names, "batch", "announced"])
            told = told[:0]

    for whole in batches:
        at, ends = 0, np.cumsum(pc.fill_null(pc.binary_length(whole.column("text_bytes")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < whole.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = min(int(np.searchsorted(ends, before + BATCH_BYTES - size)) + 1, whole.num_rows)
            held.append(whole.slice(at, stop - at))
            size, at = size + int(ends[stop - 1]) - before, stop
            if size >= BATCH_BYTES:
                yield from batch()
                number, held, size = number + 1, [], 0
    if held:
        yield from batch()


SHIPPED = "anchor long, batch long, number long, doc long, size long, content binary"


def _ship(table: pa.Table, shared: pa.Table) -> pa.Table:
    """A batch's distinct stretches under prefixes that other documents have too, unless there are too many for a tree."""
    columns, names = [[] for _ in range(6)], [c.split()[0] for c in SHIPPED.split(", ")]
    if shared.num_rows and table.num_rows:
        batch, anchors = Batch(table), _unsigned(shared["anchor"])
        part = batch.under(anchors)
        at = batch.sample[part]
        columns = [batch.anchor[at].view(np.int64), np.full(len(part), table["batch"][0].as_py()), part, batch.least[part], batch.size[at], [batch.stretch(i) for i in at.tolist()]]
    kinds = [pa.int64()] * 5 + [pa.binary()]
    give_back()
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


WINDOWS = "to_batch long, window long, low long, high long"


def _whole_windows(table: pa.Table, shared: pa.Table) -> pa.Table:
    """A batch's distinct windows under prefixes with too many stretches, each with its smallest and largest document."""
    names = [c.split()[0] for c in WINDOWS.split(", ")]
    if not shared.num_rows or not table.num_rows:
        return pa.table([pa.array([], pa.int64())] * 4, names)
    _, docs, hashes = Batch(table).windows(_unsigned(shared["anchor"]))
    order = np.lexsort((docs, hashes))
    low = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order][:1]))
    high = np.append(low[1:], len(order)) - 1
    give_back()
    return pa.table([pa.array(np.full(len(low), table["batch"][0].as_py())), _signed(hashes[order[low]]), pa.array(docs[order[low]]), pa.array(docs[order[high]])], names)


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows by several keys below 2**21, three at most; equal rows alike."""
    whole = keys[0].astype(np.int64)
    for k in keys[1:]:
        whole = whole << 21 | k
    return np.unique(whole, return_inverse=True)[1]


class Subtree:
    """The suffix tree of some suffixes of a sequence, to a depth of LENGTH words.

    order: the suffixes as they sort; depth: for each but the first, at how many words it parts from the one before. An
    internal node is a run of suffixes between which no depth falls below the node's own.
    """

    def __init__(self, names: np.ndarray, starts: np.ndarray):
        """names: words as numbers below 2**21; starts: suffixes with LENGTH words at least."""
        padded = np.concatenate([names, np.zeros(LENGTH, np.int64)])
        n = len(names)
        at = lambda r, k: np.concatenate([r, np.zeros(LENGTH, np.int64)])[k : k + n]
        levels = [(1, padded[:n])]
        for width in (1, 3, 9):
            r = levels[-1][1]
            levels.append((3 * width, _ranks(r, at(r, width), at(r, 2 * width))))
        long = levels[-1][1]
        whole = _ranks(long[starts], long[starts + LENGTH - 27])
        by = np.argsort(whole, kind="stable")
        self.order = by
        s, equal = starts[by], np.zeros(len(by), bool)
        equal[1:] = whole[by][1:] == whole[by][:-1]
        self.depth = np.where(equal, LENGTH, 0)
        apart = np.flatnonzero(~equal)[1:] if len(by) else np.empty(0, np.int64)
        depth = np.zeros(len(apart), np.int64)
        for width, r in reversed(levels):
            for _ in range(2):
                x, y = s[apart] + depth, s[apart - 1] + depth
                inside = depth + width <= LENGTH
                depth += np.where(inside & (r[np.minimum(x, n - 1)] == r[np.minimum(y, n - 1)]), width, 0)
        self.depth[apart] = depth

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The topmost nodes of at least this depth, leaves included, as slices (low, high) of order."""
        low = np.flatnonzero(self.depth < depth)
        return low, np.append(low[1:], len(self.order))


#: What a batch hears: windows start to stop of a stretch (number) have a source, or the smallest document of a window.
FOUND = "to_batch long, number long, start long, stop long, window long, least long"


def _found(batch: np.ndarray, number: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Table:
    return pa.table([pa.array(c, pa.int64()) for c in (batch, number, start, stop)] + [pa.nulls(len(batch), pa.int64())] * 2, [c.split()[0] for c in FOUND.split(", ")])


def _sources(table: pa.Table) -> pa.Table:
    """Which windows of a group's stretches stand in a smaller document: for each batch (stretch, first window, end)."""
    docs, sizes, batches, numbers = (table[c].to_numpy() for c in ("doc", "size", "batch", "number"))
    raw = table["content"].to_pylist()
    known: dict[bytes, int] = {}
    same = np.fromiter((known.setdefault(c, len(known)) for c in raw), np.int64, len(raw))  # stretches with the same words are in the tree once
    del known
    order = np.lexsort((docs, same))
    first = order[np.flatnonzero(np.diff(same[order], prepend=-1))]
    ids: dict[bytes, int] = {}
    names = np.array([ids.setdefault(w, len(ids)) for i in first.tolist() for w in raw[i].split()], np.int64)
    del raw, ids
    if not len(names):
        return _found(*[np.empty(0, np.int64)] * 4)
    size = sizes[first]
    begins = np.cumsum(size + LENGTH - 1) - size - LENGTH + 1
    starts = np.repeat(begins - np.cumsum(size) + size, size) + np.arange(size.sum())
    least = np.empty(len(starts), np.int64)
    for part in _parts(names, starts):
        tree = Subtree(*part[:2])
        low, high = tree.nodes(LENGTH)
        of = part[2][tree.order]
        least[of] = np.repeat(np.minimum.reduceat(np.repeat(docs[first], size)[of], low), high - low)
    # every stretch asks for its own document
    at = np.cumsum(size) - size
    asked = np.repeat(at[same] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    hit = least[asked] < np.repeat(docs, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    edge = np.append(True, owner[1:] != owner[:-1])
    open_ = np.flatnonzero(hit & (edge | ~np.append(False, hit[:-1])))
    close = np.flatnonzero(hit & np.append(edge[1:] | ~hit[1:], True)) + 1
    base = (np.cumsum(sizes) - sizes)[owner[open_]]
    give_back()
    return _found(batches[owner[open_]], numbers[owner[open_]], open_ - base, close - base)


#: Words that one subtree can name.
NAMES = 1 << 21


def _parts(names: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sequence, its suffixes and their places; in parts by the suffixes' first words where it is too long for the ranks."""
    if len(names) < NAMES:
        return [(names, starts, np.arange(len(starts)))]
    count = np.cumsum(np.bincount(names[starts]))
    part = (count[names[starts]] - 1) * LENGTH // (NAMES - LENGTH)
    out = []
    for p in np.unique(part):
        mine = np.flatnonzero(part == p)
        for equal in _halved(names, starts, mine, 1):
            words = names[(starts[equal][:, None] + np.arange(LENGTH)).ravel()]
            _, dense = np.unique(words, return_inverse=True)
            out.append((dense.astype(np.int64), np.arange(len(equal)) * LENGTH, equal))
    return out


def _halved(names: np.ndarray, starts: np.ndarray, mine: np.ndarray, depth: int) -> list[np.ndarray]:
    """Suffixes that share a prefix of this many words, split by longer prefixes until each part fits; equal windows as one."""
    if len(mine) * LENGTH < NAMES or depth > LENGTH:
        return [mine]
    word = names[starts[mine] + depth - 1]
    order = np.argsort(word, kind="stable")
    cuts = np.flatnonzero(np.diff(word[order])) + 1
    return [x for part in np.split(mine[order], cuts) for x in _halved(names, starts, part, depth + 1)]


def _remove(left: pa.Table, right: pa.Table, names: list[str]) -> pa.Table:
    """Each document of a batch with what is left of it and the spans removed."""
    batch = Batch(left)
    step = np.zeros(len(batch.hashes) + 1, np.int32)
    later = batch.owner > batch.least[batch.number]  # the same stretch stands in a smaller document of the batch
    np.add.at(step, batch.first[later], 1)
    np.add.at(step, (batch.first + batch.size + LENGTH - 1)[later], -1)
    ranges = right.filter(pc.is_valid(right["number"]))
    if ranges.num_rows:
        number, start, stop = (ranges[c].to_numpy() for c in ("number", "start", "stop"))
        by = np.argsort(batch.number, kind="stable")
        low, high = np.searchsorted(batch.number[by], number), np.searchsorted(batch.number[by], number, side="right")
        times = high - low
        at = by[np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())]
        np.add.at(step, batch.first[at] + np.repeat(start, times), 1)
        np.add.at(step, batch.first[at] + np.repeat(stop, times) + LENGTH - 1, -1)
    whole = right.filter(pc.is_valid(right["window"]))
    if whole.num_rows:
        window, least = _unsigned(whole["window"]), whole["least"].to_numpy()
        order = np.argsort(window)
        at, docs, hashes = batch.windows()
        place = order[np.minimum(np.searchsorted(window[order], hashes), len(order) - 1)]
        hit = at[(window[place] == hashes) & (least[place] < docs)]
        np.add.at(step, hit, 1)
        np.add.at(step, hit + LENGTH, -1)
    gone = np.cumsum(step)[:-1] > 0
    kept, spans = [None] * len(batch.order), [None] * len(batch.order)
    for i, row in enumerate(batch.order):
        a, b = int(batch.ends[i - 1]) if i else 0, int(batch.ends[i])
        edge = np.flatnonzero(np.diff(gone[a:b], prepend=False, append=False))
        spans[row] = edge.reshape(-1, 2)
        words, stays = batch.texts[i].split(), [0, *edge.tolist(), b - a]
        kept[row] = b" ".join([w for x, y in zip(stays[::2], stays[1::2], strict=True) for w in words[x:y]] if len(edge) else words)
    flat = np.concatenate(spans) if spans else np.empty((0, 2), np.int64)
    offsets = np.cumsum([0, *map(len, spans)]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0], pa.int64()), pa.array(flat[:, 1], pa.int64())], ["start", "end"])
    sizes = np.empty(len(batch.order), np.int64)
    sizes[batch.order] = np.diff(batch.ends, prepend=0)
    give_back()
    return pa.table([*(left[c] for c in names), pa.array(sizes), pa.array(kept, pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pairs)], [*names, "n_words", "kept_text", "removed_spans"])


def dedup(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others) with n_words, kept_text (the words that are left, one blank apart) and removed_spans
    (start and end of each maximal removed run, in words of the text)."""
    more = ["n_words", "kept_text", "removed_spans"]
    docs = docs.drop(*more, "text_bytes", "batch", "announced")
    names = docs.columns
    docs = docs.withColumn("text_bytes", F.col("text").cast("binary")).drop("text")
    rest = [c for c in docs.columns if c != "text_bytes"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest, "text_bytes").schema)
    cells = docs.select(*rest, "text_bytes").mapInArrow(releasing(_deal, names=[*rest, "text_bytes"]), f"{schema}, batch bigint, {ANNOUNCED}")
    table = bucketed(cells, "dealt", "batch", BUCKETS * max(1, docs.rdd.getNumPartitions()))
    size = table.agg(F.sum(F.octet_length("text_bytes"))).first()[0] or 0
    groups = 1 + size // GROUP_BYTES
    by_batch = lambda: table.drop("announced").groupBy("batch")
    every = Window.partitionBy("anchor")  # a row for each batch at most
    announced = table.select(F.col("batch").alias("of_batch"), F.explode("announced").alias("x")).select("of_batch", "x.*")
    counted = announced.select("of_batch", "anchor", "several", F.count("*").over(every).alias("batches"), (F.sum("bytes").over(every) > HOT).alias("hot"))
    shared = cut(counted.where("batches > 1 or several").select("of_batch", "anchor", "hot"))
    shipped = by_batch().cogroup(shared.where("not hot").groupBy("of_batch")).applyInArrow(lambda a, b: _ship(a, b), SHIPPED)
    in_trees = shipped.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(groups))).applyInArrow(lambda t: _sources(t), FOUND)
    found = in_trees
    if not shared.where("hot").isEmpty():
        whole = cut(by_batch().cogroup(shared.where("hot").groupBy("of_batch")).applyInArrow(lambda a, b: _whole_windows(a, b), WINDOWS))
        least = whole.groupBy("window").agg(F.min("low").alias("least"))
        none = [F.lit(None).cast("long").alias(c) for c in ("number", "start", "stop")]
        found = found.unionByName(whole.join(least, "window").where("least < high").select("to_batch", *none, "window", "least"))
    schema += ", n_words bigint, kept_text string, removed_spans array<struct<start:bigint,end:bigint>>"
    out = by_batch().cogroup(found.groupBy("to_batch")).applyInArrow(lambda a, b: _remove(a, b, [*rest, "text_bytes"]), schema)
    return out.withColumn("text", F.col("text_bytes").cast("string")).select(*names, *more)
