"""Exact removal of repeated passages by blockwise suffix sorting with a difference cover.

A byte goes if it is covered by a run of LENGTH bytes that also starts in a document with a smaller doc_id. Equal runs of
LENGTH bytes hold the same smallest q-gram (their anchor), so anchors deal all runs into suffix buckets: what is shipped is
each stretch of neighbouring runs with one anchor, once per batch of documents, under the batch's smallest doc_id for it;
batches first announce their anchors, four bytes each, and ship only stretches whose anchor another document has too. A
bucket then sorts the suffixes of its stretches one block at a time. A block is sorted by the first V bytes; suffixes that
tie are told apart by ranks of the positions in a difference cover modulo V, precomputed for the bucket: for any two
suffixes some shift below V brings both into the cover. Memory follows the size of a bucket, not of the ties. Neighbours in
suffix order that agree on LENGTH bytes form a class, and the class's smallest doc_id decides. Each batch gets back, for
its stretches, which runs have a smaller source, and removes their bytes.

A passage that a third of all documents share is one stretch per batch, however often it occurs there.

Defined results: null text is empty; texts shorter than LENGTH lose nothing; a null doc_id comes after all others and is no
source; rows with the same doc_id are no sources for each other. Other columns are carried along (columns of its own
names, and text_bytes and batch, are replaced). An empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import give_back, mix

LENGTH = 50
#: Bytes of the q-grams among which anchors are chosen.
Q = 16
#: A perfect difference cover: every number modulo V is a difference of two of COVER.
V, COVER = 13, (0, 1, 3, 9)
#: Bytes of text in a batch and bytes of stretches in a bucket, about; suffixes in a block; positions hashed at a time.
BATCH_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20
BLOCK = 1 << 20
PIECE = 1 << 19
NO_DOC = np.int64(2**63 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _shifts() -> np.ndarray:
    """For two residues, the least shift that brings both into the cover."""
    inside = np.isin(np.arange(2 * V) % V, COVER)
    both = inside[np.arange(V)[:, None] + np.arange(V)][:, None, :] & inside[np.arange(V)[:, None] + np.arange(V)][None, :, :]
    return both.argmax(axis=2)


SHIFT = _shifts()


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse."""
    return np.cumprod(np.full(n, _MULTIPLIER)), np.cumprod(np.full(n, _INVERSE))


def stretches(text: np.ndarray, ends: np.ndarray, content_too: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first run, number of runs, anchor, content hash) of the stretches of a batch; ends: where each document ends in text.

    Without content_too the hashes of the content are left out (empty).
    """
    valid = np.ones(len(text), bool)
    for e, b in zip(ends, np.concatenate([[0], ends[:-1]]), strict=True):
        valid[max(b, e - LENGTH + 1) : e] = False
    firsts, sizes, anchors, hashes = [], [], [], []
    for at in range(0, len(text), PIECE):
        part = text[at : at + PIECE + LENGTH - 1]
        runs = len(part) - LENGTH + 1
        if runs <= 0:
            break
        h, width = _LETTERS[part], 1
        while width < Q:  # hashes of 2, 4, 8, 16 bytes
            h = h[: len(h) - width] * _MULTIPLIER + (h[width:] ^ (h[width:] >> np.uint64(29)))
            h *= np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(32)
            width *= 2
        span, width = LENGTH - Q + 1, 1
        while 2 * width <= span:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        if width < span:
            h = np.minimum(h[: width - span], h[span - width :])
        ok = valid[at : at + runs]
        start = ok.copy()
        start[1:] &= (h[1:] != h[:-1]) | ~ok[:-1]
        (first,) = np.nonzero(start)
        stop = np.flatnonzero(ok & np.append(~ok[1:] | start[1:], True)) + 1
        firsts.append(first + at)
        sizes.append(stop - first)
        anchors.append(h[first])
        if not content_too:
            continue
        powers, back = _powers(PIECE + LENGTH)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[part] * powers[: len(part)])])
        content = mix((sums[stop + LENGTH - 1] - sums[first]) * back[first]) ^ mix(h[first] + (stop - first).astype(np.uint64))
        hashes.append(content)
    if not firsts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(sizes), np.concatenate(anchors), np.concatenate(hashes) if content_too else np.empty(0, np.uint64)


class Batch:
    """The documents of a batch in a fixed order, and their stretches; with content_too which of them are distinct."""

    def __init__(self, ids: list, texts: list, content_too: bool = True):
        keys = [(NO_DOC if d is None else d, t or b"") for d, t in zip(ids, texts, strict=True)]
        self.order = sorted(range(len(keys)), key=keys.__getitem__)
        self.docs = np.array([keys[i][0] for i in self.order], np.int64)
        self.text = np.frombuffer(b"".join([keys[i][1] for i in self.order]), np.uint8)
        self.ends = np.cumsum([len(keys[i][1]) for i in self.order])
        self.first, self.size, self.anchor, content = stretches(self.text, self.ends, content_too)
        self.owner = self.docs[np.searchsorted(self.ends, self.first, side="right")]
        if not content_too:
            return
        _, self.sample, self.number = np.unique(content, return_index=True, return_inverse=True)
        self.least = self.owner[self.sample]  # documents go by doc_id, so the first place has the smallest


def gather(text: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of several slices, one after another."""
    ends = np.cumsum(sizes)
    return text[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)]


def _buckets(anchors: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(anchors) % np.uint64(buckets)).astype(np.int64)


def _marks(anchors: np.ndarray) -> np.ndarray:
    """Four bytes that stand for an anchor within its bucket; two anchors of one mark only ship more than is needed."""
    return (mix(anchors ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


def _announced(batch: Batch, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (bucket, mark) of a batch in order, and whether several of its documents hold it."""
    key = _buckets(batch.anchor, buckets) << 32 | _marks(batch.anchor)
    keys, of = np.unique(key, return_inverse=True)
    low, high = np.full(len(keys), NO_DOC), np.full(len(keys), np.iinfo(np.int64).min)
    np.minimum.at(low, of, batch.owner)
    np.maximum.at(high, of, batch.owner)
    return keys, low < high


ANNOUNCED = "bucket int, batch long, marks binary, several binary"


def _announce(table: pa.Table, buckets: int) -> pa.Table:
    """What anchors a batch has, four bytes each."""
    keys, several = _announced(Batch(table["doc_id"].to_pylist(), table["text_bytes"].to_pylist(), content_too=False), buckets)
    cuts = np.append(np.flatnonzero(np.diff(keys >> 32, prepend=-1)), len(keys))  # one entry only where no text has LENGTH bytes
    parts = list(zip(cuts[:-1], cuts[1:], strict=True))
    columns = [pa.array([int(keys[a] >> 32) for a, _ in parts], pa.int32()), pa.array([table["batch"][0].as_py()] * len(parts), pa.int64()), pa.array([(keys[a:b] & 0xFFFFFFFF).astype(np.uint32).tobytes() for a, b in parts], pa.binary()), pa.array([np.packbits(several[a:b]).tobytes() for a, b in parts], pa.binary())]
    return pa.table(columns, [c.split()[0] for c in ANNOUNCED.split(", ")])


SHARED = "batch long, bucket int, shared binary"


def _shared(table: pa.Table) -> pa.Table:
    """Which of a batch's anchors, a bit each, another document holds too."""
    marks = [np.frombuffer(x.as_buffer(), np.uint32) for x in table["marks"]]
    several = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(m)) for x, m in zip(table["several"], marks, strict=True)])
    _, of, times = np.unique(np.concatenate(marks), return_inverse=True, return_counts=True)
    often = times > 1
    np.logical_or.at(often, of, several.astype(bool))
    bits = np.split(often[of], np.cumsum([len(m) for m in marks])[:-1])
    return pa.table([table["batch"], table["bucket"], pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())], ["batch", "bucket", "shared"])


SHIPPED = "bucket int, batch long, numbers binary, docs binary, sizes binary, anchors binary, content binary"


def _ship(table: pa.Table, replies: pa.Table, buckets: int) -> pa.Table:
    """A batch's distinct stretches whose anchor stands in another document too."""
    batch = Batch(table["doc_id"].to_pylist(), table["text_bytes"].to_pylist())
    keys, _ = _announced(batch, buckets)
    bits = dict(zip(replies["bucket"].to_pylist(), replies["shared"], strict=True))
    cuts = np.append(np.flatnonzero(np.diff(keys >> 32, prepend=-1)), len(keys))
    shared = [np.unpackbits(np.frombuffer(bits[int(keys[a] >> 32)].as_buffer(), np.uint8), count=b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    keys = keys[np.concatenate(shared).astype(bool)] if shared else keys
    anchors = batch.anchor[batch.sample]
    to = _buckets(anchors, buckets)
    chosen = np.flatnonzero(np.isin(to << 32 | _marks(anchors), keys))
    order = chosen[np.argsort(to[chosen], kind="stable")]
    cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
    pack, rows = zstandard.ZstdCompressor(level=3), []
    for part in np.split(order, cuts[1:]) if len(order) else []:
        at = batch.sample[part]
        content = gather(batch.text, batch.first[at], batch.size[at] + LENGTH - 1)
        rows.append((int(to[part[0]]), table["batch"][0].as_py(), part.astype(np.int32).tobytes(), batch.least[part].tobytes(), batch.size[at].astype(np.int32).tobytes(), batch.anchor[at].tobytes(), pack.compress(content.tobytes())))
    names = [c.split()[0] for c in SHIPPED.split(", ")]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as a number that sorts like them; text has to be padded."""
    w = text.astype(np.uint64)
    for k in (1, 2, 4):
        step = w[:-k] << np.uint64(8 * k)
        step |= w[k:]
        w = step
    return w


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows by several keys, equal rows alike."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def cover_ranks(word: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the suffixes at cover positions below n by their first 4*V bytes, by position; -1 elsewhere."""
    at = np.flatnonzero(np.isin(np.arange(n) % V, COVER))
    place = np.full(n + 4 * V, -1, np.int64)
    place[at] = _dense(word[at], word[at + V - 8])
    for step in (V, 2 * V):
        place[at] = _dense(place[at], place[at + step])
    return place


def least_docs(text: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each suffix of text at starts, the smallest doc among the suffixes that agree with it on LENGTH bytes.

    starts are suffixes with LENGTH bytes at least; they are sorted block by block.
    """
    n = len(text)
    word = words(np.concatenate([text, np.zeros(LENGTH + 6 * V, np.uint8)]))
    ranks = cover_ranks(word, n + V)
    head = word[starts]
    starts = starts.astype(np.int32 if n < 1 << 31 else np.int64)
    out = np.empty(len(starts), np.int64)
    n_blocks = 1 + len(starts) // BLOCK
    splits = np.unique(np.partition(head, np.arange(1, n_blocks) * len(head) // n_blocks)[np.arange(1, n_blocks) * len(head) // n_blocks]) if n_blocks > 1 else np.empty(0, np.uint64)
    block = np.searchsorted(splits, head, side="right")
    for b in range(len(splits) + 1):
        mine = np.flatnonzero(block == b)
        if not len(mine):
            continue
        order = mine[np.lexsort((word[starts[mine] + V - 8], head[mine]))]
        order = _resolve(order, starts, word, ranks)
        s = starts[order]
        new = np.zeros(len(s), bool)
        new[0] = True
        for k in (*range(0, LENGTH - 7, 8), LENGTH - 8):
            w = word[s + k]
            new[1:] |= w[1:] != w[:-1]
        cuts = np.flatnonzero(new)
        out[order] = np.repeat(np.minimum.reduceat(docs[order], cuts), np.diff(np.append(cuts, len(s))))
    return out


def _resolve(order: np.ndarray, starts: np.ndarray, word: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Order suffixes that tie on V bytes: each round parts every tie by one of its suffixes, compared by cover ranks."""
    s = starts[order]
    tie = np.zeros(len(s), bool)
    tie[1:] = (word[s[1:]] == word[s[:-1]]) & (word[s[1:] + V - 8] == word[s[:-1] + V - 8])
    group = np.cumsum(~tie)
    live = np.flatnonzero(tie | np.append(tie[1:], False))
    order = order.copy()
    while len(live):
        s, g = starts[order[live]], group[live]
        cuts = np.flatnonzero(np.diff(g, prepend=-1))
        sizes = np.diff(np.append(cuts, len(g)))
        pivot = np.repeat(s[cuts + sizes // 2], sizes)
        shift = SHIFT[s % V, pivot % V]
        side = np.sign(ranks[s + shift] - ranks[pivot + shift])
        key = np.repeat(np.arange(len(cuts)), sizes) * 3 + side + 1
        by = np.argsort(key, kind="stable")
        order[live] = order[live][by]
        key = key[by]
        open_ = (key % 3 != 1) & (np.append(key[1:] == key[:-1], False) | np.concatenate([[False], key[1:] == key[:-1]]))
        live, group_live = live[open_], key[open_]
        group = np.full(len(order), -1, np.int64) if not len(live) else group
        group[live] = group_live
    return order


def _sources(table: pa.Table) -> pa.Table:
    """For each batch, which runs of its stretches have a source in a smaller document: (stretch, first run, end) numbers."""
    unpack = zstandard.ZstdDecompressor()
    joined = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[c]])
    numbers, docs, sizes, anchors = joined("numbers", np.int32), joined("docs", np.int64), joined("sizes", np.int32).astype(np.int64), joined("anchors", np.uint64)
    batch = np.repeat(table["batch"].to_numpy(), [len(x.as_buffer()) // 4 for x in table["numbers"]])
    _, of = np.unique(anchors, return_inverse=True)
    low, high = np.full(of.max() + 1, NO_DOC), np.full(of.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, of, docs)
    np.maximum.at(high, of, docs)
    keep = np.flatnonzero(low[of] < high[of])  # an anchor of one document only can have no source elsewhere
    empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], ["batch", "runs"])
    if not len(keep):
        return empty
    whole = np.concatenate([np.frombuffer(unpack.decompress(x.as_buffer()), np.uint8) for x in table["content"]])
    starts = np.cumsum(sizes + LENGTH - 1) - sizes - LENGTH + 1
    # stretches with the same bytes are sorted once, under their smallest document
    numbers, docs, sizes, starts, batch, anchors = (x[keep] for x in (numbers, docs, sizes, starts, batch, anchors))
    text = gather(whole, starts, sizes + LENGTH - 1)
    del whole, starts
    ends = np.cumsum(sizes + LENGTH - 1)
    raw = text.tobytes()
    known: dict[bytes, int] = {}
    same = np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(ends - sizes - LENGTH + 1, ends, strict=True)), np.int64, len(sizes))
    del raw, known
    order = np.lexsort((docs, same))
    first = order[np.flatnonzero(np.diff(same[order], prepend=-1))]  # by class: its stretch of the smallest document
    text = gather(text, (ends - sizes - LENGTH + 1)[first], sizes[first] + LENGTH - 1)
    begins = np.cumsum(sizes[first] + LENGTH - 1) - sizes[first] - LENGTH + 1
    runs = np.repeat(begins - np.cumsum(sizes[first]) + sizes[first], sizes[first]) + np.arange(sizes[first].sum())
    least = least_docs(text, runs, np.repeat(docs[first], sizes[first]))
    del text, runs
    at = np.cumsum(sizes[first]) - sizes[first]
    # every stretch of a class asks for its own document
    length = sizes
    asked = np.repeat(at[same] - np.cumsum(length) + length, length) + np.arange(length.sum())
    hit = least[asked] < np.repeat(docs, length)
    owner = np.repeat(np.arange(len(length)), length)
    inner = np.concatenate([[False], (owner[1:] == owner[:-1])])
    del asked
    open_ = np.flatnonzero(hit & ~(np.concatenate([[False], hit[:-1]]) & inner))
    close = np.flatnonzero(hit & ~(np.append(hit[1:], False) & np.append(inner[1:], False))) + 1
    if not len(open_):
        return empty
    base = (np.cumsum(length) - length)[owner[open_]]
    found = np.column_stack([numbers[owner[open_]], open_ - base, close - base]).astype(np.int32)
    of_batch = batch[owner[open_]]
    order = np.argsort(of_batch, kind="stable")
    cuts = np.flatnonzero(np.diff(of_batch[order], prepend=of_batch.min() - 1))
    parts = np.split(order, cuts[1:])
    return pa.table([pa.array([int(of_batch[p[0]]) for p in parts], pa.int64()), pa.array([found[p].tobytes() for p in parts], pa.binary())], ["batch", "runs"])


def _remove(left: pa.Table, right: pa.Table, names: list[str], text_too: bool = False) -> pa.Table:
    """Each document of a batch with what is left of it and the spans removed; as text, without letters that were cut apart."""
    batch = Batch(left["doc_id"].to_pylist(), left["text_bytes"].to_pylist())
    step = np.zeros(len(batch.text) + 1, np.int32)
    later = batch.owner > batch.least[batch.number]  # the same stretch stands in a smaller document of the batch
    np.add.at(step, batch.first[later], 1)
    np.add.at(step, (batch.first + batch.size + LENGTH - 1)[later], -1)
    if right.num_rows:
        found = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in right["runs"]]).reshape(-1, 3).astype(np.int64)
        by = np.argsort(batch.number, kind="stable")
        low, high = np.searchsorted(batch.number[by], found[:, 0]), np.searchsorted(batch.number[by], found[:, 0], side="right")
        times = high - low
        at = by[np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())]
        np.add.at(step, batch.first[at] + np.repeat(found[:, 1], times), 1)
        np.add.at(step, batch.first[at] + np.repeat(found[:, 2], times) + LENGTH - 1, -1)
    gone = np.cumsum(step)[:-1] > 0
    kept, spans = [None] * len(batch.order), [None] * len(batch.order)
    for i, row in enumerate(batch.order):
        a, b = (batch.ends[i - 1] if i else 0), batch.ends[i]
        g = gone[a:b]
        edge = np.flatnonzero(np.diff(g, prepend=False, append=False))
        kept[row] = batch.text[a:b][~g].tobytes()
        spans[row] = edge.reshape(-1, 2)
    flat = np.concatenate(spans) if spans else np.empty((0, 2), np.int64)
    offsets = np.cumsum([0, *map(len, spans)]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0], pa.int64()), pa.array(flat[:, 1], pa.int64())], ["start", "end"])
    out = pa.table([*(left[c] for c in names), pa.array(kept, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pairs)], [*names, "kept_bytes", "removed_spans"])
    return out.append_column("kept_text", pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())) if text_too else out


def _given(table: pa.Table) -> pa.Table:
    give_back()
    return table


def dedup(docs: DataFrame, text_too: bool = False) -> DataFrame:
    """docs (doc_id, text and others) with kept_bytes (what is left, as bytes) and removed_spans (start, end in bytes of the text).

    With text_too also kept_text, which drops the bytes of letters that a removed span cut apart.
    """
    more = ["kept_bytes", "removed_spans", *["kept_text"] * text_too]
    docs = docs.drop(*more, "text_bytes", "batch")
    names = docs.columns
    docs = docs.withColumn("text_bytes", F.col("text").cast("binary")).drop("text")
    size = docs.agg(F.sum(F.octet_length("text_bytes"))).first()[0] or 0
    batches, buckets = 1 + size // BATCH_BYTES, 1 + size * 4 // BUCKET_BYTES  # stretches hold a byte 3.7 times over on average
    key = F.pmod(F.xxhash64("doc_id", "text_bytes"), F.lit(batches))
    dealt = docs.withColumn("batch", key).repartition(batches, "batch")
    known = dealt.groupBy("batch").applyInArrow(lambda t: _given(_announce(t, buckets)), ANNOUNCED).groupBy("bucket").applyInArrow(lambda t: _shared(t), SHARED)
    shipped = dealt.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(lambda a, b: _given(_ship(a, b, buckets)), SHIPPED)
    replies = shipped.groupBy("bucket").applyInArrow(lambda t: _given(_sources(t)), "batch long, runs binary")
    rest = [c for c in docs.columns if c != "text_bytes"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest, "text_bytes").schema), "kept_bytes binary", "removed_spans array<struct<start:bigint,end:bigint>>", *["kept_text string"] * text_too])
    out = dealt.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(lambda a, b: _given(_remove(a, b, [*rest, "text_bytes"], text_too)), schema)
    return out.withColumn("text", F.col("text_bytes").cast("string")).select(*names, *more)
