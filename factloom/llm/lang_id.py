"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. Each language has a probability for every piece; the probability of a
word is the sum over all its segmentations into pieces, by the forward algorithm, and that of a text the product over its
words. The piece probabilities come from expected counts over all segmentations (forward and backward), gathered per
language in two rounds. Letters that no piece covers pass as single letters of a small fixed probability.

Defined results: `und` with score 0 for null text, for text without a letter, and where there is nothing to learn from;
ties go to the first language by name. Words of any length are scored whole: of a long one only the last sums, as many as
the longest piece has letters, are carried on, rescaled as they go. Only the fit cuts words of more than RUN letters into
such runs to count their pieces. Rows with a null lang teach nothing; repeated rows each get a row; extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import releasing

#: Documents per language that the fit reads, about (a uniform sample by hash of the doc_id beyond that).
TRAIN_DOCS = 3000
ROUNDS = 2
#: Letters up to which a word is scored without rescaling (a letter counts UNKNOWN at least) and is not cut by the fit.
RUN = 24
#: Words scored at a time, and letters of long words.
WORDS, LETTERS = 1024, 16_384
UNKNOWN = 1e-7
SMOOTHING = 0.05
CACHE_WORDS = 200_000
_BASE = np.uint64(0x100000001B3)
_SEED = np.uint64(0xCBF29CE484222325)


def vocabulary_pieces(path: str) -> list[str]:
    """Lower-case pieces of a sentencepiece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = {model.id_to_piece(i).lower() for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in pieces if p)


def _hash(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of code points."""
    h = np.full(codes.shape[0], _SEED, np.uint64)
    for i in range(codes.shape[1]):
        h = (h ^ codes[:, i]) * _BASE
        h ^= h >> np.uint64(32)
    return h


class Pieces:
    """Numbers of pieces by the hash of their characters, one sorted table for each length."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.tables = []
        for k in range(1, self.longest + 1):
            of = [i for i, p in enumerate(pieces) if len(p) == k]
            h = _hash(np.array([[ord(c) for c in pieces[i]] for i in of], np.uint64).reshape(-1, k))
            order = np.argsort(h)
            self.tables.append((h[order], np.array(of, np.int64)[order]))

    def at(self, codes: np.ndarray) -> np.ndarray:
        """n x length x longest: the piece that starts at a place and has 1, 2, … characters, or -1."""
        n, length = codes.shape
        out = np.full((n, length, min(self.longest, length)), -1, np.int64)
        for i in range(length):
            h = np.full(n, _SEED, np.uint64)
            for k in range(1, min(self.longest, length - i) + 1):
                h = (h ^ codes[:, i + k - 1]) * _BASE
                h ^= h >> np.uint64(32)
                keys, numbers = self.tables[k - 1]
                if len(keys):
                    j = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    out[:, i, k - 1] = np.where(keys[j] == h, numbers[j], -1)
        return out


def spelt(word: str) -> str:
    """A word opened by the vocabulary's word mark."""
    return "▁" + word


def cut_runs(word: str) -> list[str]:
    """The runs of RUN letters of a word, for the fit."""
    word = spelt(word)
    return [word[i : i + RUN] for i in range(0, len(word), RUN)]


def _by_length(runs: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the list, code points) of the runs of each length, in bounded blocks."""
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    for length in np.unique(sizes):
        (where,) = np.nonzero(sizes == length)
        step = max(1, LETTERS // int(length)) if length > RUN else WORDS
        for i in range(0, len(where), step):
            part = where[i : i + step]
            text = "".join([runs[j] for j in part])
            yield part, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64).reshape(len(part), length)


def _weights(found: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Probabilities (language first) of the pieces found; a lone letter without a piece has UNKNOWN."""
    p = np.where(found >= 0, table[:, np.maximum(found, 0)], 0.0)
    p[..., 0] = np.where(found[..., 0] >= 0, p[..., 0], UNKNOWN)
    return p


def _forward(p: np.ndarray) -> np.ndarray:
    """languages x runs x (length + 1): the sum over all segmentations of each beginning."""
    langs, n, length, longest = p.shape
    f = np.zeros((langs, n, length + 1))
    f[..., 0] = 1.0
    for end in range(1, length + 1):
        for k in range(1, min(longest, end) + 1):
            f[..., end] += f[..., end - k] * p[:, :, end - k, k - 1]
    return f


def _long_scores(codes: np.ndarray, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """languages x words: as ``_forward``, in log, for words longer than RUN: the last sums are carried from part to part."""
    n, length = codes.shape
    size = pieces.longest
    last = np.zeros((len(table), n, size))  # last[..., -k]: the sum k letters back
    last[..., -1] = 1.0
    log = np.zeros((len(table), n))
    for a in range(0, length, max(1, LETTERS // n)):
        b = min(length, a + max(1, LETTERS // n))
        begin = max(0, a - size + 1)  # pieces that end in this part begin here at the earliest
        p = _weights(pieces.at(codes[:, begin:b]), table)
        p = np.concatenate([p, np.zeros((*p.shape[:3], size - p.shape[3]))], axis=3) if p.shape[3] < size else p
        for end in range(a + 1, b + 1):
            steps = np.arange(min(size, end), 0, -1)  # longest piece first, as in last
            new = (last[..., size - len(steps) :] * p[:, :, end - steps - begin, steps - 1]).sum(axis=2)
            last = np.concatenate([last[..., 1:], new[..., None]], axis=2)
            if end % 8 == 0:
                log += np.log(new)
                last /= new[..., None]
    return log + np.log(last[..., -1])


def log_scores(runs: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """runs x languages: log probability of each run, all segmentations summed."""
    out = np.zeros((len(runs), len(table)))
    for where, codes in _by_length(runs):
        if codes.shape[1] <= RUN:
            out[where] = np.log(_forward(_weights(pieces.at(codes), table))[..., -1]).T
        else:
            out[where] = _long_scores(codes, pieces, table).T
    return out


def expected_counts(runs: list[str], times: np.ndarray, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """Expected number of each piece over all segmentations of the runs, each counted so many times, for one language."""
    counts = np.zeros(pieces.size)
    for where, codes in _by_length(runs):
        found = pieces.at(codes)
        p = _weights(found, table)
        f = _forward(p)[0]
        p, length = p[0], codes.shape[1]
        b = np.zeros((len(where), length + 1))
        b[:, length] = 1.0
        for start in range(length - 1, -1, -1):
            for k in range(1, min(pieces.longest, length - start) + 1):
                b[:, start] += p[:, start, k - 1] * b[:, start + k]
        for start in range(length):
            for k in range(1, min(pieces.longest, length - start) + 1):
                share = times[where] * f[:, start] * p[:, start, k - 1] * b[:, start + k] / f[:, length]
                hit = found[:, start, k - 1] >= 0
                np.add.at(counts, found[hit, start, k - 1], share[hit])
    return counts


@dataclass
class Model:
    """Languages and their piece probabilities (languages x pieces)."""

    langs: list[str]
    pieces: Pieces
    table: np.ndarray


def _count(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """Expected piece counts of each language in a partition, gathered over bounded blocks of distinct words."""
    model = shared.value
    number = {x: i for i, x in enumerate(model.langs)}
    total, words = np.zeros((len(model.langs), model.pieces.size)), [Counter() for _ in model.langs]

    def fold(i: int) -> None:
        runs, times = [], []
        for w, n in words[i].items():
            parts = cut_runs(w)
            runs += parts
            times += [n] * len(parts)
        if runs:
            total[i] += expected_counts(runs, np.array(times, float), model.pieces, model.table[i : i + 1])
        words[i].clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            i = number[lang]
            words[i].update((text or "").lower().split())
            if len(words[i]) > 50_000:
                fold(i)
    for i in range(len(model.langs)):
        fold(i)
        (at,) = np.nonzero(total[i])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(total[i][at])], ["lang", "piece", "n"])


def fit(docs: DataFrame, vocabulary: str) -> Model:
    """Learn from docs (doc_id, lang, text); the result holds languages x pieces numbers, whatever the table's size."""
    spark = docs.sparkSession
    docs = docs.where("lang is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}  # one row per language
    pieces = Pieces(vocabulary_pieces(vocabulary))
    langs = sorted(sizes)
    model = Model(langs, pieces, np.full((len(langs), pieces.size), 1.0 / pieces.size))
    if not langs:
        return model
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, float(min(1.0, TRAIN_DOCS / n)))]), F.col("lang"))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    rows = docs.where((chance < share) | (share >= 1)).select("lang", "text")
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)
        found = rows.mapInArrow(releasing(_count, shared=shared), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full(model.table.shape, SMOOTHING)
        np.add.at(counts, (found["lang"].to_numpy(), found["piece"].to_numpy()), found["n"].to_numpy())
        shared.destroy()
        model = Model(langs, pieces, counts / counts.sum(axis=1, keepdims=True))
    return model


class _Scores(dict):
    """Word to its row in a growing list of score rows; new words wait until the block is scored."""

    def __init__(self) -> None:
        self.waiting: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.waiting.append(word)
        return n


def _predict(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    model: Model = shared.value
    known, rows = _Scores(), np.empty((0, len(model.langs)))
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            if len(known) > CACHE_WORDS:
                known, rows = _Scores(), np.empty((0, len(model.langs)))
            texts = [np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in ((t or "").lower().split() for t in part.column(0).to_pylist())]
            if known.waiting:
                rows = np.concatenate([rows, log_scores([spelt(w) for w in known.waiting], model.pieces, model.table)])
                known.waiting.clear()
            total = np.array([rows[t].sum(axis=0) if len(t) else np.zeros(len(model.langs)) for t in texts])
            best = total.argmax(axis=1)
            score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            letters = np.array(part.column(1).to_pylist(), bool)
            langs = [model.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(langs, pa.string()), pa.array(np.where(letters, score, 0.0))], [*part.schema.names[2:], "lang_pred", "score"])


def identify(docs: DataFrame, model: Model, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, lang_pred and score (the language's share of the probability of the text) for each row of docs (keys, text)."""
    keyed = [F.col(k).cast("long").alias(k) for k in keys]
    if not model.langs:
        return docs.select(*keyed, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col("text").cast("string")
    docs = docs.select(text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter"), *keyed)
    return docs.mapInArrow(releasing(_predict, shared=shared), ", ".join(f"`{k}` long" for k in keys) + ", lang_pred string, score double")
