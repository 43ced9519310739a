"""Alignment of two tokenizers' tokens over the same bytes, and counts of the token pairs that overlap.

A's tokens come from a byte-level vocabulary (tokenizers), B's from one with byte fallback (sentencepiece). Both divide the
same bytes, so the ends of their tokens, found by cumulative sums of the tokens' lengths, are places on one line and are marked
there: ends that both have cut the tokens into groups, which running counts number, and a repeat of each A token by the
number of B tokens it overlaps gives the links, all for a batch of documents at once. No token of either vocabulary spans the place between a letter and a blank that follows it, so texts are encoded in
pieces that begin there. A worker encodes a piece once and keeps a bounded number of them, those that are used most; new ones
are encoded many at a time, as one text, which is divided again where the bytes of its pieces end.

Encoded documents are written to the shared folder once, bucketed by batches of bounded size, each with its distinct pairs
and how often each is linked. The batches' counts are summed in two shuffles, first by pair and a salt of the batch, then by pair, so that
a pair that stands in all batches is summed by many tasks. A batch then gets back the totals of its own distinct pairs,
never of all links, and sums them by document.

Defined results: null or empty texts, and texts of which either vocabulary's tokens don't spell the bytes of the blank and
the text (such as one with a literal U+2581), have no tokens and zeros throughout. A very long text is a batch of its own.
Ties for a B token's highest count are all best. Repeated rows, and rows with a null id, each get a row; other columns are
ignored whatever their names, and an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import bucketed, give_back, releasing
from factloom.llm.trie_bpe import byte_letters

#: Bytes of text in a batch, about, and rows at most.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 20_000
#: Pieces that a worker keeps, twice as many and CACHE_LETTERS letters at most, beside those of the texts at hand; then only the
#: most used ones of at most PIECE letters stay.
CACHE_PIECES, CACHE_LETTERS, PIECE = 120_000, 4 << 20, 64
#: New pieces that are encoded as one text.
TOGETHER = 256
#: Tasks among which the counts of one pair are summed first.
SALTS = 16
#: Buckets of the written table for each partition of the documents.
BUCKETS = 4
#: A pair of tokens is the number a * PAIR + b.
PAIR = 1 << 31
#: A blank after white space: there a piece must not begin.
_UNSAFE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def pieces(text: str) -> list[str]:
    """The pieces of a blank and a text, each without the blank that it begins with."""
    if not _UNSAFE.search(f" {text}"):
        return text.split(" ")
    return [p[1:] for p in _CUT.split(f" {text}")]


@dataclass(frozen=True)
class Lists:
    """Lists of ids, one after another, and where each ends."""

    flat: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, parts: Iterable[Lists]) -> Lists:
        """The lists of all parts."""
        parts = list(parts)
        begins = np.cumsum([0, *(len(p.flat) for p in parts)])
        return cls(np.concatenate([p.flat for p in parts]), np.concatenate([p.ends + i for p, i in zip(parts, begins, strict=False)]))

    def take(self, which: np.ndarray) -> Lists:
        sizes = np.diff(self.ends, prepend=0)[which]
        ends = np.cumsum(sizes)
        return Lists(self.flat[np.repeat(self.ends[which] - ends, sizes) + np.arange(ends[-1] if len(ends) else 0)], ends)

    def grouped(self, until: np.ndarray) -> Lists:
        """Joined lists: the first until[0], then those up to until[1] and so on."""
        return Lists(self.flat, np.concatenate([[0], self.ends])[until])

    def as_bytes(self) -> list[bytes]:
        raw, ends = self.flat.astype("<u4").tobytes(), (4 * self.ends).tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def _divided(ids: list[int], table: list[bytes], size: np.ndarray, want: list[bytes]) -> Lists | None:
    """The ids of each wanted text, of those of all; None where the tokens don't spell them or span two of them."""
    if b"".join(map(table.__getitem__, ids)) != b"".join(want):
        return None
    flat, ends = np.array(ids, np.uint32), np.cumsum(list(map(len, want)))
    until = np.cumsum(size[flat])
    last = np.searchsorted(until, ends)
    return Lists(flat, last + 1) if np.array_equal(until[last], ends) else None


def _numbering(names: list[str]) -> defaultdict[str, int]:
    """Each name's number; a name that is not there yet gets the next one."""
    numbers = defaultdict(None, zip(names, range(len(names)), strict=True))
    numbers.default_factory = numbers.__len__
    return numbers


class Vocabularies:
    """Two tokenizers with the bytes of their tokens, and the pieces that are kept, with their ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        value = {c: i for i, c in enumerate(byte_letters())}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in vocab.items():
            if all(c in value for c in token):
                self.bytes_a[i] = bytes(map(value.__getitem__, token))
        names = map(self.b.id_to_piece, range(self.b.get_piece_size()))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        if any("▁" in p.lstrip("▁") for p in map(self.b.id_to_piece, range(self.b.get_piece_size()))):
            raise ValueError("a vocabulary whose pieces hold blanks only in front is needed")
        self.len_a = np.array(list(map(len, self.bytes_a)), np.int64)
        self.len_b = np.array(list(map(len, self.bytes_b)), np.int64)
        self.known, self.uses, self.spelt, self.letters = _numbering([]), np.empty(0, np.int64), np.empty(0, bool), 0
        self.ids = [Lists(np.empty(0, np.uint32), np.empty(0, np.int64)) for _ in "AB"]

    def _both(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's and B's ids of a blank and each text."""
        a = self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)
        return [e.ids for e in a], self.b.encode(texts, num_threads=1)

    def _encode(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of each text, as both vocabularies encode a blank and it; None where the tokens don't spell these bytes."""
        want = [f" {t}".encode() for t in texts]
        both = [self._spelt(ids, table, want) for ids, table in zip(self._both(texts), (self.bytes_a, self.bytes_b), strict=True)]
        return [x if None not in x else None for x in zip(*both, strict=True)]

    @staticmethod
    def _spelt(ids: list[list[int]], table: list[bytes], want: list[bytes]) -> list[bytes | None]:
        """Each list of ids as bytes; None where its tokens don't spell what is wanted."""
        return [np.array(x, "<u4").tobytes() if b"".join(map(table.__getitem__, x)) == w else None for x, w in zip(ids, want, strict=True)]

    def _encode_new(self, new: list[str]) -> tuple[list[Lists], np.ndarray]:
        """A's and B's ids of each piece, and whether both spell it (if not, it has none).

        A piece that ends with a letter may be followed by another one's blank, so such pieces are encoded together; they are
        encoded alone where the whole does not spell them.
        """
        together, alone = [], []
        for i, p in enumerate(new):
            (together if p and len(p) <= PIECE and not p[-1].isspace() and "▁" not in p else alone).append(i)
        blocks = [together[i : i + TOGETHER] for i in range(0, len(together), TOGETHER)]
        order, parts = [], ([], [])
        for block, *both in zip(blocks, *self._both([" ".join([new[i] for i in block]) for block in blocks]), strict=True):
            want = [f" {new[i]}".encode() for i in block]
            found = [_divided(ids, table, size, want) for ids, table, size in zip(both, (self.bytes_a, self.bytes_b), (self.len_a, self.len_b), strict=True)]
            if None in found:
                alone += block
            else:
                order += block
                for part, x in zip(parts, found, strict=True):
                    part.append(x)
        spelt = np.ones(len(new), bool)
        for at in range(0, len(alone), 4096):
            block = alone[at : at + 4096]
            found = self._encode([new[i] for i in block])
            spelt[block] = [x is not None for x in found]
            order += block
            for k, part in enumerate(parts):
                raw = [x[k] if x else b"" for x in found]
                part.append(Lists(np.frombuffer(b"".join(raw), "<u4"), np.cumsum([len(x) // 4 for x in raw])))
        place = np.empty(len(new), np.int64)
        place[order] = np.arange(len(new))
        return [Lists.of(part).take(place) for part in parts], spelt

    def _forget(self) -> None:
        """Keep the pieces that were used most."""
        names = list(self.known)
        short = np.flatnonzero(np.array(list(map(len, names))) <= PIECE)
        stay = np.sort(short[np.argsort(-self.uses[short], kind="stable")[:CACHE_PIECES]])
        names = list(map(names.__getitem__, stay.tolist()))
        self.known, self.uses, self.spelt, self.letters = _numbering(names), self.uses[stay] // 2, self.spelt[stay], sum(map(len, names))
        self.ids = [x.take(stay) for x in self.ids]

    def encode_texts(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """A's and B's ids of each text, as little-endian unsigned 32-bit integers; both empty where it has no tokens."""
        if len(self.known) > 2 * CACHE_PIECES or self.letters > CACHE_LETTERS:
            self._forget()
        split, before = [pieces(t) if t else [] for t in texts], len(self.known)
        until = np.cumsum(list(map(len, split)), dtype=np.int64)
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        new = list(islice(self.known, before, None))
        if new:
            ids, spelt = self._encode_new(new)
            self.ids = [Lists.of(x) for x in zip(self.ids, ids, strict=True)]
            self.spelt, self.letters = np.append(self.spelt, spelt), self.letters + sum(map(len, new))
        uses = np.bincount(which, minlength=len(self.known))
        uses[:before] += self.uses
        self.uses = uses
        out = list(zip(*(x.take(which).grouped(until).as_bytes() for x in self.ids), strict=True))
        for i in np.unique(np.searchsorted(until, np.flatnonzero(~self.spelt[which]), side="right")).tolist():
            (whole,) = self._encode([texts[i]])  # what the pieces spell differs; the whole decides
            out[i] = whole or (b"", b"")
        return out


@lru_cache(maxsize=2)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


@dataclass(frozen=True)
class Alignment:
    """Ends of the groups, the group of each token, and the links as places in both token lists."""

    cuts: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(size_a: np.ndarray, size_b: np.ndarray) -> Alignment:
    """The alignment of two divisions of the same bytes, given as the lengths of their tokens."""
    ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
    mark_a, mark_b = (np.zeros(1 + (ends[-1] if len(ends) else 0), bool) for ends in (ends_a, ends_b))
    mark_a[ends_a] = mark_b[ends_b] = True
    common_a, common_b = mark_b[ends_a], mark_a[ends_b]
    ended = np.cumsum(mark_b, dtype=np.int32)  # tokens of B that end at a place or before it
    first = ended[ends_a - size_a].astype(np.int64)
    times = ended[ends_a - 1] - first + 1
    links = np.cumsum(times)
    link_a = np.repeat(np.arange(len(size_a)), times)
    link_b = np.arange(links[-1] if len(links) else 0) + np.repeat(first - links + times, times)
    return Alignment(ends_a[common_a], np.cumsum(common_a) - common_a, np.cumsum(common_b) - common_b, link_a, link_b)


def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all documents one after another, and where each document's ids end."""
    return np.frombuffer(b"".join(ids), "<u4").astype(np.int64), np.cumsum([len(i) // 4 for i in ids])


def _links(ids_a: np.ndarray, ids_b: np.ndarray, v: Vocabularies) -> tuple[Alignment, np.ndarray]:
    """The alignment of a batch's tokens, and the pair of each link."""
    found = align(v.len_a[ids_a], v.len_b[ids_b])
    return found, ids_a[found.link_a] * PAIR + ids_b[found.link_b]


ENCODED = "batch long, doc_id long, a_ids binary, b_ids binary, pairs array<long>, times array<long>"


def _encode(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Rows of ids in batches; the first row of a batch also holds its distinct pairs and their numbers of links."""
    v, number = vocabularies(*paths), TaskContext.get().partitionId() << 32
    names = [c.split()[0] for c in ENCODED.split(", ")]

    def batch_of(docs: list, ids: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        (a, _), (b, _) = _joined([x for x, _ in ids]), _joined([x for _, x in ids])
        pairs, times = np.unique(_links(a, b, v)[1], return_counts=True)
        rest = [None] * (len(docs) - 1)
        columns = [pa.array([number] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array([x for x, _ in ids], pa.binary()), pa.array([x for _, x in ids], pa.binary()), pa.array([pairs, *rest], pa.list_(pa.int64())), pa.array([times, *rest], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names)

    docs, ids, size = [], [], 0
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            part = whole.slice(at, 256)
            texts, start, chars = part.column(1).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                chars += len(t or "")
                if chars < BATCH_BYTES // 4 and i + 1 < len(texts):
                    continue
                docs += part.column(0)[start : i + 1].to_pylist()
                ids += v.encode_texts(texts[start : i + 1])
                size += chars
                start, chars = i + 1, 0
                if size >= BATCH_BYTES or len(docs) >= BATCH_ROWS:
                    yield batch_of(docs, ids)
                    docs, ids, size, number = [], [], 0, number + 1
    if docs:
        yield batch_of(docs, ids)


def encode(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Documents (doc_id, text) as ids of both vocabularies, in numbered batches; written to the shared folder and read back.

    The table (of a name of its own) is bucketed by batch, so that a batch meets its replies without another shuffle of the
    ids. The paths have to be readable on every executor.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = BUCKETS * max(1, rows.rdd.getNumPartitions())
    return bucketed(rows.mapInArrow(releasing(_encode, paths=(path_a, path_b)), ENCODED), "encoded", "batch", buckets)


def batch_pairs(encoded: DataFrame) -> DataFrame:
    """batch, pair, times: each batch's distinct pairs."""
    return encoded.where("pairs is not null").select("batch", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("batch", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))


def pair_counts(encoded: DataFrame) -> DataFrame:
    """pair, a_id, b_id, links (corpus-wide), best (no other A token is linked with b_id more often)."""
    salted = batch_pairs(encoded).groupBy("pair", F.pmod(F.xxhash64("batch"), F.lit(SALTS)).alias("salt")).agg(F.sum("times").alias("links"))
    counts = salted.groupBy("pair").agg(F.sum("links").alias("links")).withColumn("b_id", F.col("pair") % PAIR)
    highest = counts.groupBy("b_id").agg(F.max("links").alias("highest"))  # a row for each of B's tokens at most
    return counts.join(F.broadcast(highest), "b_id").select("pair", F.shiftright("pair", 31).cast("int").alias("a_id"), F.col("b_id").cast("int").alias("b_id"), "links", (F.col("links") == F.col("highest")).alias("best"))


class _Spelling:
    """The text of groups: a1,a2|b1;a3|b2,b3."""

    def __init__(self, n_a: int, n_b: int):
        self.shift = n_a + n_b
        self.n_a = n_a
        numbers = [*map(str, range(n_a)), *map(str, range(n_b))]
        parts = [n + "," for n in numbers] + [n + "|" for n in numbers[:n_a]] + [n + ";" for n in numbers[n_a:]]
        self.parts, self.sizes = np.array(parts, "S"), np.array(list(map(len, parts)))

    def spell(self, ids_a: np.ndarray, ids_b: np.ndarray, found: Alignment, ends: np.ndarray) -> list[str]:
        """Each token, in the order of groups and A before B, with the sign that follows it; divided where documents end."""
        last_a, last_b = (np.append(np.diff(group) != 0, True)[: len(group)] for group in (found.group_a, found.group_b))
        token = np.empty(len(ids_a) + len(ids_b), np.int64)
        until_a, until_b = np.flatnonzero(last_a) + 1, np.append(0, np.flatnonzero(last_b) + 1)
        token[np.arange(len(ids_a)) + until_b[found.group_a]] = ids_a + last_a * self.shift
        token[np.arange(len(ids_b)) + until_a[found.group_b]] = ids_b + self.n_a + last_b * self.shift
        text = self.parts[token].tobytes().translate(None, b"\0").decode("ascii")
        until = np.append(0, np.cumsum(self.sizes[token]))[ends].tolist()
        return [text[i : max(i, j - 1)] for i, j in zip([0, *until], until, strict=False)]


@lru_cache(maxsize=2)
def _spelling(n_a: int, n_b: int) -> _Spelling:
    return _Spelling(n_a, n_b)


ALIGNED = "doc_id long, a_ids binary, b_ids binary, groups string, n_groups long, n_links long, n_best long, count_sum long"


def _aligned(rows: pa.Table, counts: pa.Table, paths: tuple[str, str]) -> pa.Table:
    """The groups of each document of a batch, and the totals of its links."""
    v = vocabularies(*paths)
    (a, ends_a), (b, ends_b) = _joined(rows["a_ids"].to_pylist()), _joined(rows["b_ids"].to_pylist())
    found, pairs = _links(a, b, v)
    order = np.argsort(counts["pair"].to_numpy())
    at = order[np.searchsorted(counts["pair"].to_numpy()[order], pairs)] if len(pairs) else np.empty(0, np.int64)
    until = lambda x: np.concatenate([[0], np.cumsum(x)])
    ends_links = np.searchsorted(found.link_a, ends_a)
    by_doc = lambda x, ends: np.diff(until(x)[ends], prepend=0)
    ends_groups = np.concatenate([[0], found.group_a + 1])[ends_a]
    groups = _spelling(len(v.bytes_a), len(v.bytes_b)).spell(a, b, found, ends_a + ends_b)
    totals = [np.diff(ends_groups, prepend=0), np.diff(ends_links, prepend=0), by_doc(counts["best"].to_numpy()[at].astype(np.int64), ends_links), by_doc(counts["links"].to_numpy()[at], ends_links)]
    give_back()
    return pa.table([rows["doc_id"], rows["a_ids"], rows["b_ids"], pa.array(groups, pa.string()), *(pa.array(t, pa.int64()) for t in totals)], [c.split()[0] for c in ALIGNED.split(", ")])


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Each document (doc_id, text) with both vocabularies' ids (little-endian unsigned 32-bit), its groups as text, and the
    numbers of groups and links, of links that are their B token's best, and the sum of the links' corpus-wide counts."""
    encoded = encode(docs, path_a, path_b)
    replies = batch_pairs(encoded).join(pair_counts(encoded), "pair").select(F.col("batch").alias("to_batch"), "pair", "links", "best")
    rows = encoded.select("batch", "doc_id", "a_ids", "b_ids")
    return rows.groupBy("batch").cogroup(replies.groupBy("to_batch")).applyInArrow(lambda x, y: _aligned(x, y, (path_a, path_b)), ALIGNED)
