"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Every benchmark item is cut into patterns: windows of WINDOW characters of its normalized text, one from every word's start
and from every STRIDE-th character, or the whole of a shorter item. So a copied excerpt of WINDOW characters from a word's
start, or of WINDOW + STRIDE - 1 from anywhere, holds a whole window and is found; shorter ones are found where they come
within k edits of one. A text holds a pattern within k edits only if some run of neighbouring diagonals, as wide as the edits can
drift, holds at least (m - q + 1) - k * q of the pattern's q-grams at matching places. So the text's q-grams are looked up
in the benchmark's, hits are counted per item in overlapping diagonal bands, bands that could meet the bound are counted per
pattern by place, those that meet it are retained, and a banded alignment of pattern and region decides.

Texts are normalized before: lower case, every run of characters that are neither letters nor digits becomes one blank.
The benchmark is read in blocks of bounded size, each of which is broadcast and held against all documents in one scan
without a shuffle: a stated query set in blocks, whatever the sizes of the two tables.

Defined results: null or empty texts match nothing; items whose normalized text is shorter than q characters have no q-gram
and are found where their words stand as they are, and empty ones nowhere; equal items are each reported; a null doc_id or item_id is reported as null. Repeated rows each
report their matches; an empty benchmark or table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import mix, releasing

WINDOW = 60
STRIDE = 10
Q = 9
#: Edits allowed in a pattern, as a share of its length (rounded down).
EDITS = 0.08
#: Characters of benchmark text in a block, about.
BLOCK_CHARS = 2_000_000
_FILTER_BITS = 22
_NOT_WORD = regex.compile(r"[^\p{L}\p{N}]+")


def normalized(text: str | None) -> str:
    return _NOT_WORD.sub(" ", (text or "").lower()).strip()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the q-grams at every place."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(Q):
        h = h * np.uint64(0x100000001B3) + codes[i : i + n]
    return mix(h)


def starts(codes: np.ndarray) -> np.ndarray:
    """Where the patterns of an item begin."""
    last = len(codes) - WINDOW
    if last <= 0:
        return np.zeros(1, np.int64)
    words = np.flatnonzero(codes[:-1] == ord(" ")) + 1
    return np.unique(np.concatenate([np.arange(0, last, STRIDE), words[words < last], [last]]))


@dataclass
class Index:
    """Patterns of a block of items, and the places of the items' q-grams by hash.

    An item's patterns follow each other and are of one size; they are slices of its characters, kept once.
    """

    items: list
    codes: list[np.ndarray]
    pattern_item: np.ndarray
    pattern_start: np.ndarray
    edits: np.ndarray
    needed: np.ndarray
    first_pattern: np.ndarray  # of each item, and one more
    hashes: np.ndarray  # sorted and distinct
    first: np.ndarray  # of each hash, into the two below
    of_item: np.ndarray
    of_place: np.ndarray
    filter: np.ndarray
    short: dict  # first word to (item, normalized text) of items shorter than a q-gram

    def pattern(self, i: int) -> np.ndarray:
        return self.codes[self.pattern_item[i]][self.pattern_start[i] : self.pattern_start[i] + WINDOW]

    @property
    def patterns(self) -> list[np.ndarray]:
        return [self.pattern(i) for i in range(len(self.pattern_item))]


def build(items: list[tuple[int | None, str | None]]) -> Index:
    ids, kept, short = [], [], {}
    for item_id, text in items:
        plain = normalized(text)
        if len(plain) >= Q:
            ids.append(item_id)
            kept.append(_codes(plain))
        elif plain:
            short.setdefault(plain.split(" ")[0], []).append((item_id, plain))
    for of_word in short.values():
        for i, (item_id, plain) in enumerate(of_word):
            of_word[i] = (len(ids), plain)
            ids.append(item_id)
    begin = [starts(c) for c in kept]
    count = np.array([len(b) for b in begin], np.int64)
    sizes = np.repeat(np.array([min(len(c), WINDOW) for c in kept], np.int64), count)
    edits = np.minimum((sizes * EDITS).astype(np.int64), np.maximum((sizes - Q) // Q, 0))  # a bound of one q-gram at least
    needed = sizes - Q + 1 - edits * Q
    none = np.empty(0, np.int64)
    found = [grams(c) for c in kept]
    h = np.concatenate(found) if found else np.empty(0, np.uint64)
    which = np.repeat(np.arange(len(kept)), [len(x) for x in found]) if found else none
    place = np.concatenate([np.arange(len(x)) for x in found]) if found else none
    order = np.argsort(h, kind="stable")
    hashes, first = np.unique(h[order], return_index=True)
    bloom = np.zeros(1 << _FILTER_BITS, bool)
    bloom[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    owner = np.repeat(np.arange(len(kept)), count) if kept else none
    return Index(ids, kept, owner, np.concatenate(begin) if begin else none, edits, needed, np.append(0, np.cumsum(count)), hashes, np.append(first, len(h)), which[order], place[order], bloom, short)


def _repeated(first: np.ndarray, times: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for times[i] numbers, one after another."""
    return np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def candidates(codes: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, first diagonal of the band) of every band of a text that holds enough q-grams of a pattern."""
    h = grams(codes)
    none = np.empty(0, np.int64)
    (at,) = np.nonzero(index.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    if not len(at):
        return none, none
    j = np.minimum(np.searchsorted(index.hashes, h[at]), len(index.hashes) - 1)
    ok = index.hashes[j] == h[at]
    at, j = at[ok], j[ok]
    if not len(at):
        return none, none
    times = index.first[j + 1] - index.first[j]
    hit = _repeated(index.first[j], times)
    item, place = index.of_item[hit], index.of_place[hit]
    base = max(map(len, index.codes))
    diagonal = np.repeat(at, times) - place + base  # not negative
    # bands are 2k+1 wide at least and overlap by half: any k neighbouring diagonals lie in one of them
    some = index.first_pattern[item]  # the patterns of an item have one size
    band = diagonal // (np.maximum(index.edits[some], 1) + 1)
    key = np.concatenate([item * (1 << 40) + band, item * (1 << 40) + np.maximum(band - 1, 0)])
    place = np.concatenate([place, place])
    keys, of, n = np.unique(key, return_inverse=True, return_counts=True)
    # no pattern of an item has more hits in a band than the item
    enough = n >= index.needed[index.first_pattern[keys >> 40]]
    if not enough.any():
        return none, none
    number = np.cumsum(enough) - 1
    keep = enough[of]
    keys = keys[enough]
    item = keys >> 40
    times = index.first_pattern[item + 1] - index.first_pattern[item]
    pattern = _repeated(index.first_pattern[item], times)
    which = np.repeat(np.arange(len(keys)), times)
    wide = base + WINDOW + 1
    spots = np.sort(number[of[keep]] * wide + place[keep])
    lo = which * wide + index.pattern_start[pattern]
    grams_of = index.needed[pattern] + index.edits[pattern] * Q
    n = np.searchsorted(spots, lo + grams_of) - np.searchsorted(spots, lo)
    ok = n >= index.needed[pattern]
    pattern, which = pattern[ok], which[ok]
    band = keys[which] & ((1 << 40) - 1)
    return pattern, band * (np.maximum(index.edits[pattern], 1) + 1) - base + index.pattern_start[pattern]


def aligned(patterns: list[np.ndarray], texts: list[np.ndarray], first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each pattern against its text, over the diagonals first .. first + width - 1, and where the match ends.

    The match may begin and end anywhere in the band; all alignments advance together, one pattern character at a time.
    """
    n, m = len(patterns), max(map(len, patterns))
    p = np.full((n, m), -1, np.int64)
    for i, x in enumerate(patterns):
        p[i, : len(x)] = x
    span = m + width
    t = np.full((n, span), -2, np.int64)
    for i, (x, f) in enumerate(zip(texts, first, strict=True)):
        lo, hi = max(0, f), min(len(x), f + span)
        if hi > lo:
            t[i, lo - f : hi - f] = x[lo:hi]
    far = 1 << 20
    d = np.zeros((n, width), np.int64)  # d[:, w]: the pattern so far against text that ends at diagonal first + w
    best, ends = np.full(n, far), np.zeros(n, np.int64)
    sizes = np.array([len(x) for x in patterns])
    for i in range(m):
        new = d + (t[:, i : i + width] != p[:, i : i + 1])  # same diagonal: match or substitution
        new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)  # a pattern character without text moves one diagonal down
        new = np.minimum.accumulate(new - np.arange(width), axis=1) + np.arange(width)  # text without pattern moves up
        d = new
        done = sizes == i + 1
        if done.any():
            w = d[done].argmin(axis=1)
            best[done], ends[done] = d[done, w], first[done] + w + i + 1
    return best, ends


def _short_matches(texts: list[str], index: Index) -> list[tuple[int, int, int, int, int]]:
    """The same for items shorter than a q-gram, word by word and without edits."""
    out = []
    for x, text in enumerate(texts):
        padded = f" {text} "
        for word in index.short.keys() & set(text.split(" ")):
            for item, plain in index.short[word]:
                at = padded.find(f" {plain} ")
                while at >= 0:
                    out.append((x, item, at, at + len(plain), 0))
                    at = padded.find(f" {plain} ", at + 1)
    return sorted(out)


def matches(texts: list[str], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of the verified regions, merged where one item's regions touch; places in normalized text."""
    short = _short_matches(texts, index) if index.short else []
    if not len(index.pattern_item):
        return short
    where, pattern, first, codes = [], [], [], []
    for i, text in enumerate(texts):
        c = _codes(text)
        codes.append(c)
        pat, dia = candidates(c, index)
        where += [i] * len(pat)
        pattern += pat.tolist()
        first += dia.tolist()
    out: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for s in range(0, len(where), 20_000):
        w, p, f = where[s : s + 20_000], pattern[s : s + 20_000], np.array(first[s : s + 20_000])
        width = 2 * (int(index.edits[p].max()) + 2) + 1
        cut = [index.pattern(x) for x in p]
        best, ends = aligned(cut, [codes[x] for x in w], f, width)
        for x, y, c, e, b in zip(w, p, cut, ends, best, strict=True):
            if b <= index.edits[y]:
                out.setdefault((x, int(index.pattern_item[y])), []).append((int(max(0, e - len(c))), int(e), int(b)))
    merged = []
    for (x, item), spans in sorted(out.items()):
        lo, hi, edits = None, None, 0
        for a, b, e in sorted(set(spans)):
            if lo is not None and a <= hi:
                hi, edits = max(hi, b), min(edits, e)
                continue
            if lo is not None:
                merged.append((x, item, lo, hi, edits))
            lo, hi, edits = a, b, e
        merged.append((x, item, lo, hi, edits))
    return merged + short


def _search(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    index: Index = shared.value
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            found = matches([normalized(t) for t in part.column(0).to_pylist()], index)
            columns = list(zip(*found, strict=True)) or [()] * 5
            keys = [k.take(pa.array(columns[0], pa.int64())) for k in part.columns[1:]]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([index.items[x] for x in columns[1]], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[2:])], [*part.schema.names[1:], "item_id", "start", "end", "edits"])


def contaminated(docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, item_id, start, end, edits: each region of a document (keys, text) that holds a passage of benchmark (item_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("text").cast("string").alias("text"), *(F.col(k).cast("long").alias(k) for k in keys))
    schema = ", ".join(f"`{k}` long" for k in keys) + ", item_id long, start int, end int, edits int"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + int(chars) // BLOCK_CHARS
    out = spark.range(0).select(*(F.lit(None).cast(c.split()[-1]).alias(c.split()[0].strip("`")) for c in schema.split(", ")))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()  # bounded by BLOCK_CHARS, about
        index = build(sorted(((r["item_id"], r["text"]) for r in rows), key=str))
        if index.items:
            shared = spark.sparkContext.broadcast(index)
            out = out.union(docs.mapInArrow(releasing(_search, shared=shared), schema))
    return out
