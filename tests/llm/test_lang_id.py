"""The forward sum against enumeration, and held-out accuracy."""

import numpy as np
import pytest

from factloom.llm import lang_id, q_text

PIECES = ["▁", "▁a", "a", "b", "ab", "▁ab", "bab"]


def table():
    return np.array([[0.1, 0.2, 0.1, 0.1, 0.2, 0.1, 0.2], [0.3, 0.1, 0.1, 0.2, 0.1, 0.1, 0.1]])


def ways(text, p):
    """All segmentations of a text as (probability, pieces)."""
    if not text:
        yield 1.0, []
        return
    for k in range(1, len(text) + 1):
        x = text[:k]
        q = p[PIECES.index(x)] if x in PIECES else lang_id.UNKNOWN if k == 1 else None
        if q is not None:
            for r, rest in ways(text[k:], p):
                yield q * r, [x, *rest]


def test_forward_and_expected_counts():
    runs = [lang_id.spelt("abab"), lang_id.spelt("bab"), lang_id.spelt("aéb"), "bab", "b"]
    pieces = lang_id.Pieces(PIECES)
    got = lang_id.log_scores(runs, pieces, table())
    want = [[np.log(sum(q for q, _ in ways(r, p))) for p in table()] for r in runs]
    assert np.allclose(got, want)
    times = np.array([1.0, 2.0, 3.0, 1.0, 5.0])
    expected = np.zeros(len(PIECES))
    for r, n in zip(runs, times, strict=True):
        total = sum(q for q, _ in ways(r, table()[0]))
        for q, xs in ways(r, table()[0]):
            for x in xs:
                if x in PIECES:
                    expected[PIECES.index(x)] += n * q / total
    assert np.allclose(lang_id.expected_counts(runs, times, pieces, table()[:1]), expected)


def plain(text, p):
    """Log of the forward sum, one number at a time, in whole fractions."""
    from fractions import Fraction

    f = [Fraction(1)]
    for end in range(1, len(text) + 1):
        at = lambda k: p[PIECES.index(text[end - k : end])] if text[end - k : end] in PIECES else lang_id.UNKNOWN if k == 1 else 0  # noqa: E731, B023
        f.append(sum(f[end - k] * Fraction(float(at(k))) for k in range(1, min(3, end) + 1)))
    return float(f[-1].numerator.bit_length() - f[-1].denominator.bit_length()) * np.log(2), f[-1]


@pytest.mark.parametrize("letters", [1, 7, 64, 16_384])
def test_long_words_are_summed_whole(monkeypatch, letters):
    monkeypatch.setattr(lang_id, "LETTERS", letters)
    words = [lang_id.spelt(w) for w in ("ab" * 12, "bab" * 8 + "é", "aéb" * 40, "ab" * 300, "é" * 200, "ba" * 12, "ab" * 11 + "a", "bab" * 100)]
    got = lang_id.log_scores(words, lang_id.Pieces(PIECES), table())
    for w, row in zip(words, got, strict=True):
        for p, x in zip(table(), row, strict=True):
            rough, exact = plain(w, p)
            assert abs(x - (rough + np.log(float(exact / 2 ** round(rough / np.log(2))) if rough > 0 else float(exact * 2 ** round(-rough / np.log(2)))))) < 1e-6 * len(w)


def test_every_piece_of_the_vocabulary_counts():
    path = q_text.vocabulary("piece_bpe_32k.model")
    pieces = lang_id.vocabulary_pieces(path)
    index = lang_id.Pieces(pieces)
    assert index.longest == max(map(len, pieces)) > 10
    longest = [p for p in pieces if len(p) == index.longest][0]
    codes = np.array([[ord(c) for c in longest]], np.uint64)
    assert index.at(codes)[0, 0, index.longest - 1] == pieces.index(longest)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = q_text.op1_lang_id(spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 200 and np.mean([r.lang_pred == r.lang for r in got]) > 0.98


def test_odd_rows(spark):
    path = q_text.vocabulary("piece_bpe_32k.model")
    schema = "doc_id long, text string, lang string, score string"
    train = spark.createDataFrame([(1, "the of and to", "en", "x"), (2, "der die und das", "de", "x"), (3, None, "de", "x"), (4, "x", None, "x")], schema)
    docs = spark.createDataFrame([(1, None, None, "x"), (2, "", "en", "x"), (3, "12 ?!", "en", "x"), (3, "12 ?!", "en", "x"), (None, "the and", None, "x"), (5, "und" * 20_000, None, "x")], schema)
    got = {(r.doc_id, r.lang_pred) for r in lang_id.identify(docs, lang_id.fit(train, path)).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (None, "en"), (5, "de")}
    nothing = lang_id.fit(train.where("false"), path)
    assert {(r.lang_pred, r.score) for r in lang_id.identify(docs, nothing).collect()} == {("und", 0.0)}
    assert lang_id.identify(docs.where("false"), lang_id.fit(train, path)).count() == 0
