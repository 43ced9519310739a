"""Whitening against NumPy on whole tables, and against plain arithmetic on odd vectors."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from factloom.llm import q_vectors, whitening

SF = "/root/testdata/sf0.001"


def numbers_of(vector):
    return tuple(floor(64 * Fraction(c)) + 1_000_000 for c in vector)


def expected(vectors, k):
    """n, sums, eigenvalues and what whitens, in plain double precision from exact sums."""
    x = sorted({numbers_of(v) for v in vectors})
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(row, sums, strict=True)] for row in x])
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    return n, sums, values[::-1][:k], axes[:, ::-1][:, :k], v


def test_whole_table(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    n, sums, values, axes, v = expected(rows.values(), 16)
    got = q_vectors.op11_whitening(spark, SF).collect()
    assert len(got) == 16 * len(rows) and {r.n for r in got} == {n}
    white = np.zeros((len(rows), 16))
    place = {d: i for i, d in enumerate(rows)}
    for r in got:
        x = numbers_of(rows[r.vec_id])
        assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-9)
        white[place[r.vec_id], r.component - 1] = r.whitened
    centred = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(numbers_of(e), sums, strict=True)] for e in rows.values()])
    want = centred @ (axes / np.sqrt(values))
    want *= np.sign((want * white).sum(axis=0))
    assert np.abs(want - white).max() < 1e-8
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -2.0, 0.25]), (2, [0.5, -2.0, 0.25]), (2, [1.5, 0.0, 0.25]), (None, [-3.0, 9.0, 0.25]), (4, None), (5, [0.1, None, 0.2]), (6, [0.1, nan, 0.2]), (7, [0.1, -inf, 0.2]), (8, [1.0]), (9, []), (10, [1e6, -1e6, 0.25])]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "vec_id long, embedding array<double>, code string, n int, `key` string")
    got = whitening.whiten(df, 16).collect()
    kept = [r for r in rows if r[0] not in (4, 5, 6, 7, 8, 9)]
    assert sorted((r.vec_id for r in got), key=str) == sorted((d for d, _ in kept), key=str)
    n, sums, values, axes, v = expected([e for _, e in kept], 3)
    assert n == 4 and {r.n for r in got} == {4}
    assert sorted(int(r.deviation) for r in got) == sorted(sum((n * c - s) ** 2 for c, s in zip(numbers_of(e), sums, strict=True)) for _, e in kept)
    assert all(r.whitened[2] == 0 and r.explained[2] == 0 for r in got)  # the third dimension has no variance
    assert got[0].identity_error < 1e-6 and sum(got[0].explained) == pytest.approx(1)


def test_one_vector_and_none(spark):
    one = spark.createDataFrame([(1, [0.5, 1.0])] * 3, "vec_id long, embedding array<float>")
    got = whitening.whiten(one).collect()
    assert [(r.n, int(r.deviation), list(r.whitened), list(r.explained), r.identity_error) for r in got] == [(1, 0, [0.0, 0.0], [0.0, 0.0], 0.0)] * 3
    assert whitening.whiten(one.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [None])], "vec_id long, embedding array<float>")).count() == 0


def test_far_numbers_are_exact(spark):
    rows = [(i, [float(2**45 + i), -float(2**40 * i), 3e300]) for i in range(5)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [(64 * (2**45 + i) + 1_000_000, -64 * 2**40 * i + 1_000_000, 2**52 + 1_000_000) for i in range(5)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert sorted(int(r.deviation) for r in got) == sorted(sum((5 * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x)


def test_packing_is_one_to_one():
    x = np.array([[0, -128], [127, 1], [128, 1], [-129, 0], [2**31, 5], [-(2**52), 2**52], [0, 0]], np.int64)
    import pyarrow as pa

    codes = whitening.pack(x)
    assert [c[0] for c in codes] == [1, 1, 2, 2, 8, 8, 1]
    assert (whitening.unpack(pa.array(codes, pa.binary()), 2) == x).all()
