"""BPE encoding and decoding over a trie of distinct words.

New words of a block of documents form a trie. A depth-first walk carries, for every prefix, its *last-token state*: the
one token that ends the encoding of that prefix. The state of a prefix follows from the states of shorter prefixes, since
an encoding is right exactly when each pair of adjacent tokens is: so a shared prefix is encoded once, and the encoding of
a word is read back along its states. Words closed by the end-of-word mark differ from prefixes only in their last symbol.

The trie is kept as its words in order: depth-first order is alphabetical order, the node where a word leaves the path of
the word before is the end of their common prefix, and the path itself is the walk's stack. So memory follows the longest
word and words of any length take the same way.

Defined results: null or empty text gives no tokens and an empty decoded text; the strings of special tokens in a text
become those tokens, as in the library's default; a very long word takes time and memory linear in its length. Repeated
rows each get a row, other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import releasing

#: Words (about 200 bytes each) that a worker keeps; twice as many at most, as the older half is dropped at once.
CACHE_WORDS = 150_000
#: Pairs of tokens (about 120 bytes each) whose test a worker keeps.
CACHE_PAIRS = 200_000
BLOCK_CHARS = 500_000
END = "</w>"
#: Token numbers are below 1 << SHIFT.
SHIFT = 20


def byte_letters() -> str:
    """The printable stand-ins of the 256 byte values in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


class TrieBpe:
    """The tokenizer of a vocabulary file whose words end in a mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("end_of_word_suffix") != END or spec.get("decoder") or model.get("dropout"):
            raise ValueError("a byte-level BPE vocabulary with end-of-word marks and no decoder is needed")
        self.names = {i: t for t, i in model["vocab"].items()}
        self.inner = {t: i for t, i in model["vocab"].items() if not t.endswith(END)}
        self.final = {t[: -len(END)]: i for t, i in model["vocab"].items() if t.endswith(END) and t != END}
        vocab = model["vocab"]
        #: Of a pair of tokens, the rank of its merge; of a token, that rank and the pair.
        self.ranks, self.made = {}, {}
        for rank, (a, b) in enumerate(map(tuple, model["merges"])):
            if vocab[a + b] in self.made:
                raise ValueError("a vocabulary with one merge for each token is needed")
            self.ranks[vocab[a] << SHIFT | vocab[b]] = rank
            self.made[vocab[a + b]] = (rank, vocab[a], vocab[b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.cut_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        (split,) = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.find_words = regex.compile(split).findall
        self.letters = {i: c for i, c in enumerate(byte_letters())}
        self.agrees: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.beginnings = {t[:i] for t in [*self.inner, *self.final] for i in range(len(t) + 1)}
        self.states: dict[str, tuple] = {}

    def normalized(self, text: str) -> str:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # letter by letter: no final sigma

    def _adjoin(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge of a rank below limit joins the two tokens at any time while they are merged from their letters.

        Merges are undone in turn, the last one first; each undoing bares a pair at the boundary, which must not have been
        merged before. Of equal ranks the left one came first.
        """
        ranks, made, letter = self.ranks, self.made, (-1, 0, 0)
        while True:
            if ranks.get(left << SHIFT | right, limit) < limit:
                return False
            a, b = made.get(left, letter), made.get(right, letter)
            if a[0] > b[0]:
                limit, left = a[0], a[2]
            elif b[0] >= 0:
                limit, right = b[0] + 1, b[1]
            else:
                return True

    def _follows(self, before: int, token: int) -> bool:
        """Whether the two tokens are the encoding of their joined text (before < 0: whether the token is that of its own)."""
        key = before << SHIFT | token
        ok = self.agrees.get(key)
        if ok is None:
            if before >= 0:
                ok = self._adjoin(before, token, len(self.ranks))
            else:
                rank, a, b = self.made.get(token, (-1, 0, 0))
                ok = rank < 0 or self._follows(-1, a) and self._follows(-1, b) and self._adjoin(a, b, rank)
            if len(self.agrees) > CACHE_PAIRS:
                self.agrees.clear()
            self.agrees[key] = ok
        return ok

    def _suffixes(self, text: str) -> tuple:
        """The automaton's state for a text: its longest suffix that begins a token, with moves by letter and the tokens that end it, longest first."""
        while text not in self.beginnings:
            text = text[1:]
        state = self.states.get(text)
        if state is None:
            ends = [text[i:] for i in range(len(text))]
            sound = lambda of: [(of[x], len(x)) for x in ends if x in of and self._follows(-1, of[x])]
            state = self.states[text] = ({}, sound(self.inner), sound(self.final), text)
        return state

    def _last(self, tokens: list[tuple[int, int]], depth: int, last: list[int]) -> tuple[int, int]:
        """The one of the tokens that ends the encoding of the first depth symbols, with its length."""
        agrees = self.agrees
        for found in tokens:
            before = last[depth - found[1]]
            ok = before < 0 or agrees.get(before << SHIFT | found[0])
            if ok or ok is None and self._follows(before, found[0]):
                return found
        raise ValueError("the vocabulary lacks a token for a byte")

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of each distinct word, found in one depth-first walk over the trie of all of them."""
        out, find, move = {}, self._last, self._move
        states, last, size = [self._suffixes("")], [-1], [0]  # of every prefix on the path
        path = ""
        for spelt, word in sorted((w.encode("utf-8").decode("latin-1").translate(self.letters), w) for w in words):
            depth, end = 0, len(spelt) - 1  # the last symbol carries the end-of-word mark
            for x, y in zip(path, spelt[:-1], strict=False):
                if x != y:
                    break
                depth += 1
            del states[depth + 1 :], last[depth + 1 :], size[depth + 1 :]
            state = states[depth]
            for c in spelt[depth:end]:
                depth += 1
                state = state[0].get(c) or move(state, c)
                token, n = find(state[1], depth, last)
                states.append(state)
                last.append(token)
                size.append(n)
            path = spelt[:-1]
            state = state[0].get(spelt[-1]) or move(state, spelt[-1])
            token, n = find(state[2], end + 1, last)
            ids, at = [token], end + 1 - n
            while at:
                ids.append(last[at])
                at -= size[at]
            out[word] = array("I", ids[::-1]).tobytes()
        return out

    def _move(self, state: tuple, letter: str) -> tuple:
        to = state[0][letter] = self._suffixes(state[3] + letter)
        return to

    def encode_texts(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Ids and decoded text of each text. A word is encoded once and kept; new words of the block share a trie."""
        if len(self.known) > CACHE_WORDS:
            self.older, self.known = self.known, {}
        known, older, special = self.known, self.older, self.special
        split = []
        for text in texts:
            words = []
            for part in self.cut_special.split(text) if "<|" in (text or "") else [text or ""]:
                words += [special[part]] if part in special else self.find_words(self.normalized(part))
            split.append(words)
        new = []
        for word in set().union(*split):
            if word not in known:
                if word in older:
                    known[word] = older[word]
                elif isinstance(word, int):
                    known[word] = array("I", [word]).tobytes()
                else:
                    new.append(word)
        known.update(self.encode_words(new))
        ids = [b"".join(map(known.__getitem__, words)) for words in split]
        return [(x, self.decode(array("I", x))) for x in ids]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> TrieBpe:
    return TrieBpe(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = tokenizer(path)
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            start, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t or "") + 1
                if size >= BLOCK_CHARS or i + 1 == len(texts):
                    found = bpe.encode_texts(texts[start : i + 1])
                    yield pa.RecordBatch.from_arrays([ids[start : i + 1], pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], ["doc_id", "ids", "decoded"])
                    start, size = i + 1, 0


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (token ids as little-endian unsigned 32-bit integers) and decoded text for each row of docs (doc_id, text).

    vocabulary is the path of the tokenizer's file, readable on every executor. Rows need no shuffle: each worker keeps a
    bounded cache of words.
    """
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(releasing(_encode, path=vocabulary), "doc_id long, ids binary, decoded string")
