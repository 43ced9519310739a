"""Token alignment against one that goes byte by byte, with the libraries' own whole-text encodings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factloom.llm import q_text, token_alignment as ta

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def paths():
    return q_text.vocabulary("byte_bpe_50k.json"), q_text.vocabulary("piece_bpe_32k.model")


def stand_in():
    """Byte-level spelling: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Whole:
    """Both libraries over whole texts."""

    def __init__(self, paths):
        self.a, self.b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
        self.a.encode_special_tokens = True
        self.value = stand_in()

    def tokens(self, text):
        """(id, bytes) of A and of B; none where they don't spell the text."""
        if not text:
            return [], []
        a = [(i, bytes(self.value[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()) for i in self.b.encode(text) for p in [self.b.id_to_piece(i)]]
        want = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def brute(rows, paths):
    whole, docs, counts = Whole(paths), [], Counter()
    for d, text in rows:
        a, b = whole.tokens(text)
        at_a = [i for i, (_, x) in enumerate(a) for _ in x]  # the token of each byte
        at_b = [i for i, (_, x) in enumerate(b) for _ in x]
        links = sorted(set(zip(at_a, at_b, strict=True)))
        counts.update((a[i][0], b[j][0]) for i, j in links)
        docs.append((d, a, b, at_a, at_b, links))
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(n, highest.get(y, 0))
    out = []
    for d, a, b, at_a, at_b, links in docs:
        n = len(at_a)
        cuts = [0] + [i for i in range(1, n + 1) if i == n or (at_a[i] != at_a[i - 1] and at_b[i] != at_b[i - 1])] if n else []
        said = lambda ids, at, i, j: ",".join(str(ids[t][0]) for t in sorted(set(at[i:j])))
        groups = ";".join(f"{said(a, at_a, i, j)}|{said(b, at_b, i, j)}" for i, j in zip(cuts, cuts[1:], strict=False))
        of = [counts[a[i][0], b[j][0]] for i, j in links]
        best = sum(c == highest[b[j][0]] for c, (_, j) in zip(of, links, strict=True))
        out.append((d, len(a), len(b), max(len(cuts) - 1, 0), len(links), best, sum(of), hashlib.sha256(groups.encode()).hexdigest() if n else ""))
    return sorted(out, key=str)


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n b\n", "x▁y", "▁", "<|endoftext|> <s> </s> <unk> <0x41>", "\t\ttab", "n b   m", "\x00 \x01", "naïve Ωδ 中文字 🙂 é", "it's we'll I'd", "12 345 6.7", "\x1c x", "don 't  's", "\r\n\r\n x", "a" * 300, "é" * 90 + " end", "x� y퟿", "ﬁ Ａ ²"]


def test_whole_table(spark, paths):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in q_text.op12_token_alignment(spark, SF).collect()), key=str) == brute(rows, paths)


def test_odd_texts(spark, paths, monkeypatch):
    rows = [*enumerate(ODD), (None, "a b"), (3, "a b"), (3, "a b")]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, batch string, pairs int")
    got = [(r.doc_id, len(r.a_ids) // 4, len(r.b_ids) // 4, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.n_groups else "") for r in ta.aligned(df, *paths).collect()]
    assert sorted(got, key=str) == brute(rows, paths)
    assert ta.aligned(df.limit(0), *paths).count() == 0


def test_pieces_give_the_whole_encoding(paths):
    rng, v, whole = random.Random(3), ta.Vocabularies(*paths), Whole(paths)
    letters = ["a", "the", " ", " ", " ", "\n", "\t", "'s", "é", "9", ".", " ", " ", "\x1f", "🙂", "▁", "Word", "ing"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    for text, (a, b) in zip(texts, v.encode_texts(texts), strict=True):
        want_a, want_b = whole.tokens(text)
        assert (np.frombuffer(a, "<u4").tolist(), np.frombuffer(b, "<u4").tolist()) == ([i for i, _ in want_a], [i for i, _ in want_b]), repr(text)


def test_counts_over_many_batches(spark, paths, monkeypatch):
    rows = [(i, f"shared passage {i % 7} of words and words") for i in range(60)]
    monkeypatch.setattr(ta, "BATCH_ROWS", 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_best, r.count_sum) for r in ta.aligned(df, *paths).collect())
    assert got == sorted((r[0], r[5], r[6]) for r in brute(rows, paths))


class Counting:
    """A library's encoder that counts the texts that it is given."""

    def __init__(self, encoder):
        self.encoder, self.texts = encoder, 0

    def __getattr__(self, name):
        def call(texts, **options):
            self.texts += len(texts)
            return getattr(self.encoder, name)(texts, **options)

        return call


def test_new_pieces_are_encoded_together(paths):
    rng, v, whole = random.Random(5), ta.Vocabularies(*paths), Whole(paths)
    texts = [" ".join("".join(rng.choices("abcdeéß.,\n'", k=rng.randint(1, 12))) for _ in range(200)) for _ in range(40)]
    texts += ["a▁b c", "ends with a blank ", "and a line\n", "\n \nx", "w" * 500 + " y"]
    v.a, v.b = Counting(v.a), Counting(v.b)
    got = v.encode_texts(texts)
    for text, (a, b) in zip(texts, got, strict=True):
        want_a, want_b = whole.tokens(text)
        assert (np.frombuffer(a, "<u4").tolist(), np.frombuffer(b, "<u4").tolist()) == ([i for i, _ in want_a], [i for i, _ in want_b]), repr(text)
    distinct = len({p for t in texts for p in ta.pieces(t)})
    assert distinct > 5000
    assert max(v.a.texts, v.b.texts) < distinct / 3, "pieces that end with a letter are encoded as one text with others"


def test_forgotten_pieces_change_nothing(paths, monkeypatch):
    rng, texts = random.Random(7), [None, "", "x▁y"]
    texts += [" ".join("".join(rng.choices("abcé\n.", k=rng.choice([1, 2, 3, 90]))) for _ in range(30)) for _ in range(60)]
    want = ta.Vocabularies(*paths).encode_texts(texts)
    for name, bound in (("CACHE_PIECES", 40), ("CACHE_LETTERS", 200)):
        with monkeypatch.context() as m:
            m.setattr(ta, name, bound)
            v = ta.Vocabularies(*paths)
            assert [x for i in range(0, len(texts), 3) for x in v.encode_texts(texts[i : i + 3])] == want
            v._forget()
            assert len(v.known) == len(v.uses) == len(v.spelt) == len(v.ids[0].ends) == len(v.ids[1].ends)
            assert len(v.known) <= ta.CACHE_PIECES and max(map(len, v.known)) <= ta.PIECE
