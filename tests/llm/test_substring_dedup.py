"""Removal of repeated passages of words against brute force over all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from factloom.llm import q_passages, substring_dedup as sd

SF = "/root/testdata/sf0.001"


def brute(rows):
    least, split = {}, [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - sd.LENGTH + 1):
            k = tuple(w[i : i + sd.LENGTH])
            if d is not None:
                least[k] = min(d, least.get(k, d))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - sd.LENGTH + 1):
            x = least.get(tuple(w[i : i + sd.LENGTH]))
            if x is not None and (d is None or x < d):
                gone[i : i + sd.LENGTH] = [True] * sd.LENGTH
        spans = [(i, next((j for j in range(i, len(w)) if not gone[j]), len(w))) for i in range(len(w)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((d, len(w), " ".join(x for x, g in zip(w, gone, strict=True) if not g), spans))
    return sorted(out, key=str)


def rows_of(rng, n=120):
    words = ["".join(rng.choice("abé ") for _ in range(rng.randint(1, 5))) for _ in range(80)]
    said = lambda k: rng.choice([" ", "  ", "\n", " \t"]).join(rng.choice(words) for _ in range(k))
    common = [said(rng.randint(40, 160)) for _ in range(6)]
    rows = [(i, " ".join(rng.choice([said(rng.randint(1, 60)), rng.choice(common), "x " * rng.randint(1, 120), "a b " * rng.randint(1, 60)]) for _ in range(rng.randint(0, 5)))) for i in range(n)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (-1, rows[40][1]), (None, rows[7][1]), (None, rows[7][1]), (7, rows[9][1]), (502, None), (503, ""), (504, "y " * 49), (505, "y " * 49), (506, "z " * 50), (507, " z" * 50)]
    rng.shuffle(rows)
    return rows


def result(df):
    return sorted(((r.doc_id, r.n_words, r.kept_text, [tuple(s) for s in r.removed_spans]) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot", [0, 2000, 4 << 20])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "BATCH_BYTES", 9000)
    monkeypatch.setattr(sd, "GROUP_BYTES", 9000)
    monkeypatch.setattr(sd, "HOT", hot)
    rows = rows_of(random.Random(5 + hot))
    df = spark.createDataFrame([(*r, "k", "n") for r in rows], "doc_id long, text string, batch string, anchor string")
    got = sd.dedup(df)
    assert result(got) == brute(rows)
    assert {r.anchor for r in got.collect()} == {"n"}


@pytest.mark.parametrize("rows", [[], [(1, "short"), (2, "short")], [(1, None), (None, None)], [(None, "y " * 50), (3, "y " * 50), (4, "y " * 51)]])
def test_small_tables(spark, rows):
    assert result(sd.dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_subtree_sorts_and_measures():
    rng = np.random.default_rng(4)
    for letters in (2, 5, 40):
        names = rng.integers(0, letters, 900)
        names[500:700] = names[100:300]
        starts = rng.permutation(900 - sd.LENGTH + 1)
        tree = sd.Subtree(names, starts)
        of = [tuple(names[s : s + sd.LENGTH]) for s in starts[tree.order]]
        shared = [next((k for k in range(sd.LENGTH) if x[k] != y[k]), sd.LENGTH) for x, y in zip(of, of[1:], strict=False)]
        assert of == sorted(of) and tree.depth[1:].tolist() == shared
        low, high = tree.nodes(sd.LENGTH)
        assert [len(set(of[a:b])) for a, b in zip(low, high, strict=True)] == [1] * len(set(of))
        low, high = tree.nodes(2)
        assert [len({x[:2] for x in of[a:b]}) for a, b in zip(low, high, strict=True)] == [1] * len({x[:2] for x in of})


def test_long_groups_are_split_by_prefix(spark, monkeypatch):
    monkeypatch.setattr(sd, "NAMES", 2000)
    rows = rows_of(random.Random(9))
    assert result(sd.dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {(d, n, sum(b - a for a, b in spans), hashlib.sha256(kept.encode()).hexdigest()) for d, n, kept, spans in brute(rows)}
    assert {tuple(r) for r in q_passages.op13_substring_dedup(spark, SF).collect()} == want
