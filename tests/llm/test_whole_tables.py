"""Queries over whole tables against brute force, and oracles where SQL has them."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from factloom.llm import decontaminate, lang_id, q_passages, q_quality, q_text, quality_qda, quality_rules, registry, text_stats
from tests.llm.test_decontaminate import distance
from tests.llm.test_near_dup import brute as near_brute
from tests.llm.test_quality import brute as counted
from tests.llm.test_suffix_dedup import brute as passage_brute
from tests.oracle import compare, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_near_duplicates(spark, rows):
    assert sorted((tuple(r) for r in q_text.op5_near_dup(spark, SF).collect()), key=str) == near_brute(rows, 3, 85, 100)


def test_passages(spark, rows):
    sizes = {d: len((t or "").encode()) for d, t in rows}
    want = {(d, sizes[d], sizes[d] - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for d, kept, spans in passage_brute(rows)}
    assert {tuple(r) for r in q_passages.op9_suffix_dedup(spark, SF).collect()} == want


def test_bpe(spark, rows):
    t = Tokenizer.from_file(q_text.vocabulary("word_bpe_49k.json"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {d: t.encode(x or "", add_special_tokens=False).ids for d, x in rows}
    want = {(d, len(i), sha(np.array(i, "<u4").tobytes()), sha(t.decode(i, skip_special_tokens=False).encode())) for d, i in ids.items()}
    assert {tuple(r) for r in q_text.op4_bpe(spark, SF).collect()} == want


def features(text):
    """The shares of a text, from its counts, one number at a time."""
    c = dict(zip(text_stats.COUNTS, text_stats.counts(None if text is None else text.encode()), strict=True))
    over = lambda a, b: c[a] / c[b] if c[b] else 0.0
    return c, {
        "words": float(c["n_words"]), "mean_word": over("word_chars", "n_words"), "longest": float(c["longest_word"]), "symbols": over("n_symbols", "n_words"), "dup_lines": over("n_dup_lines", "n_lines"),
        "repeats": over("n_repeat_words", "n_words"), "distinct": over("n_distinct_words", "n_words"), "upper": over("n_upper", "n_chars"), "digits": over("n_digits", "n_chars"), "marks": over("n_marks", "n_words"),
        "short": over("n_short_words", "n_words"), "neighbours": over("n_repeat_neighbours", "n_words"), "line_words": over("n_words", "n_lines"),
    }


@pytest.fixture(scope="module")
def quality(spark):
    return [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]


def test_quality_rules(spark, rows, quality):
    docs = {d: features(t) for d, t in rows}
    failed = {d: c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"] for d, (c, _) in docs.items()}
    taught = sorted((d, q) for d, q in quality if q in (0, 1) and d in docs and not failed[d])
    learned = quality_rules.learn({k: np.array([docs[d][1][k] for d, _ in taught]) for k in text_stats.shares()}, np.array([q == 0 for _, q in taught]))
    assert learned
    first = lambda x: next((i for i, r in enumerate(learned, 1) if all(x[c.feature] >= c.cut if c.above else x[c.feature] < c.cut for c in r)), None)
    want = {(d, *counted(dict(rows)[d]), failed[d], not failed[d] and first(x) is None) for d, (_, x) in docs.items()}
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in q_quality.op6_quality_rules(spark, SF).collect()}
    assert got == want and {r[-1] for r in got} == {True, False}


def test_quality_classifier(spark, rows, quality):
    sizes = {"words", "mean_word", "longest", "line_words"}
    x = {d: np.array([np.log1p(v) if k in sizes else np.sqrt(v) for k, v in features(t)[1].items()]) for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 3 == 1 for d in x}
    of = [[x[d] for d, q in quality if q == c and d in x and not held[d]] for c in (0, 1)]
    means = [np.mean(p, axis=0) for p in of]
    covs = [sum(np.outer(v - m, v - m) for v in p) / len(p) for p, m in zip(of, means, strict=True)]
    pooled = sum(c * len(p) for c, p in zip(covs, of, strict=True)) / sum(map(len, of))
    a, b = quality_qda.TO_POOLED, quality_qda.TO_DIAGONAL
    covs = [(1 - b) * ((1 - a) * c + a * pooled) + b * np.diag(np.diag(pooled) + 1e-6) for c in covs]
    density = lambda v, c: np.log(len(of[c])) - 0.5 * (v - means[c]) @ np.linalg.inv(covs[c]) @ (v - means[c]) - 0.5 * np.linalg.slogdet(covs[c])[1]
    want = {d: 1 / (1 + np.exp(np.clip(density(v, 0) - density(v, 1), -500, 500))) for d, v in x.items()}
    got = q_quality.op7_quality_classifier(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-6 and r.held_out == held[r.doc_id] and r.predicted == (r.score >= 0.5)


def test_language_id(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lang_id.fit(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"), q_text.vocabulary("piece_bpe_32k.model"))
    pieces = {p: i for i, p in enumerate(lang_id.vocabulary_pieces(q_text.vocabulary("piece_bpe_32k.model")))}
    known = {}

    def log(word):
        if word not in known:
            f = [np.ones(len(model.langs))]
            for end in range(1, len(word) + 1):
                p = lambda k: model.table[:, pieces[word[end - k : end]]] if word[end - k : end] in pieces else lang_id.UNKNOWN if k == 1 else 0.0  # noqa: E731, B023
                f.append(sum(f[end - k] * p(k) for k in range(1, min(model.pieces.longest, end) + 1)))
            known[word] = np.log(f[-1])
        return known[word]

    got = {r.doc_id: r for r in q_text.op1_lang_id(spark, SF).collect()}
    assert len(got) == len(rows)
    for d, text in rows[:60]:
        total = sum((log("▁" + w) for w in (text or "").lower().split() if len(w) < 60), np.zeros(len(model.langs)))
        if any(len(w) >= 60 for w in (text or "").split()):
            continue
        share = np.exp(total - total.max())
        if any(c.isalpha() for c in text or ""):
            assert got[d].lang_pred == model.langs[int(total.argmax())] and abs(got[d].score - 1 / share.sum()) < 1e-6
        else:
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)


def test_decontamination_reports_true_regions(spark, rows):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    texts, found = {d: decontaminate.normalized(t) for d, t in rows}, q_passages.op2_decontamination(spark, SF).collect()
    assert found
    for r in found:
        index = decontaminate.build([(r.item_id, items[r.item_id])])
        region = texts[r.doc_id][max(0, r.start - 6) : r.end + 6]
        assert any(distance("".join(map(chr, p)), region) <= k for p, k in zip(index.patterns, index.edits, strict=True))
    whole = {(d, i) for d, t in texts.items() for i, s in items.items() if decontaminate.normalized(s) and decontaminate.normalized(s) in t}
    assert whole <= {(r.doc_id, r.item_id) for r in found}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(spark, name):
    _, ours, theirs = compare(spark, views(SF), SF, registry.queries()[name], registry.oracle_sql()[name])
    assert not ours and not theirs
