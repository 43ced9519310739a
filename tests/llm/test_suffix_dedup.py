"""Passage removal against brute force over all runs of bytes."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from factloom.llm import suffix_dedup as sd


def brute(rows):
    least = {}
    for d, t in rows:
        t = (t or "").encode()
        for i in range(len(t) - sd.LENGTH + 1):
            w = t[i : i + sd.LENGTH]
            if d is not None:
                least[w] = min(d, least.get(w, d))
    out = []
    for d, t in rows:
        t = (t or "").encode()
        gone = [False] * len(t)
        for i in range(len(t) - sd.LENGTH + 1):
            x = least.get(t[i : i + sd.LENGTH])
            if x is not None and (d is None or x < d):
                gone[i : i + sd.LENGTH] = [True] * sd.LENGTH
        spans = [(i, next((j for j in range(i, len(t)) if not gone[j]), len(t))) for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((d, bytes(b for b, g in zip(t, gone, strict=True) if not g), spans))
    return sorted(out, key=str)


def texts(rng, n):
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    said = lambda k: " ".join(rng.choice(words) for _ in range(k))
    common = [said(rng.randint(8, 60)) for _ in range(6)]
    for _ in range(n):
        yield " ".join(rng.choice([said(rng.randint(1, 30)), rng.choice(common), "ab" * rng.randint(1, 90), "x" * rng.randint(1, 120)]) for _ in range(rng.randint(0, 5)))


def rows_of(rng):
    rows = list(enumerate(texts(rng, 120)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (-1, rows[40][1]), (None, rows[7][1]), (7, rows[9][1]), (502, None), (503, ""), (504, "y" * 49), (505, "y" * 49), (506, "z" * 50), (507, "z" * 50)]
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sd, "BATCH_BYTES", 4000)
    monkeypatch.setattr(sd, "BUCKET_BYTES", 9000)
    rows = rows_of(random.Random(5))
    got = sd.dedup(spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, lang string")).collect()
    assert sorted(((r.doc_id, bytes(r.kept_bytes), [tuple(s) for s in r.removed_spans]) for r in got), key=str) == brute(rows)
    assert {r.lang for r in got} == {"k"} and [r.text is None for r in got].count(True) == 1


@pytest.mark.parametrize("seed", range(6))
def test_small_blocks_and_pieces(monkeypatch, seed):
    monkeypatch.setattr(sd, "BLOCK", 150)
    monkeypatch.setattr(sd, "PIECE", 333)
    rng = random.Random(seed)
    rows, buckets = rows_of(rng), rng.randint(1, 4)
    tables = [pa.table({"doc_id": pa.array([d for d, _ in part], pa.int64()), "text_bytes": pa.array([None if t is None else t.encode() for _, t in part], pa.binary()), "batch": pa.array([b] * len(part), pa.int64())}) for b in range(5) if (part := rows[b::5])]
    where = lambda t, c, v: t.filter(pa.compute.equal(t[c], v))
    grouped = lambda t, f: pa.concat_tables([f(where(t, "bucket", k)) for k in sorted(set(t["bucket"].to_pylist()))])
    known = grouped(pa.concat_tables([sd._announce(t, buckets) for t in tables]), sd._shared)
    shipped = pa.concat_tables([sd._ship(t, where(known, "batch", t["batch"][0]), buckets) for t in tables])
    replies = grouped(shipped, sd._sources)
    got = pa.concat_tables([sd._remove(t, where(replies, "batch", t["batch"][0]), ["doc_id"]) for t in tables]).to_pylist()
    assert sorted(((r["doc_id"], r["kept_bytes"], [(s["start"], s["end"]) for s in r["removed_spans"]]) for r in got), key=str) == brute(rows)


def test_blockwise_order(monkeypatch):
    rng = np.random.default_rng(2)
    for alphabet, n, block in ((2, 4000, 256), (1, 700, 64), (4, 3000, 1 << 20)):
        monkeypatch.setattr(sd, "BLOCK", block)
        text = rng.integers(97, 97 + alphabet, n).astype(np.uint8)
        text[n // 2 :] = text[: n - n // 2]
        starts = rng.permutation(n - sd.LENGTH + 1)
        docs = rng.integers(0, 50, len(starts))
        least = {}
        for s, d in zip(starts, docs, strict=True):
            w = text[s : s + sd.LENGTH].tobytes()
            least[w] = min(d, least.get(w, d))
        assert sd.least_docs(text, starts, docs).tolist() == [least[text[s : s + sd.LENGTH].tobytes()] for s in starts]


@pytest.mark.parametrize("rows", [[(1, "short"), (2, "short")], [(1, "")], [(1, None), (None, None)], [(None, "y" * 49), (3, "y" * 50), (4, "")]])
def test_texts_below_the_length(spark, rows):
    got = sd.dedup(spark.createDataFrame(rows, "doc_id long, text string"), text_too=True).collect()
    assert sorted(((r.doc_id, bytes(r.kept_bytes), [tuple(s) for s in r.removed_spans]) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    assert sd.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
