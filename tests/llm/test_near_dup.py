"""Near-duplicates against brute force."""

import random

import pytest

from factloom.llm.near_dup import near_duplicates


def brute(rows, k, num, den):
    import re

    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        return ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}) if w else set()

    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * len(sets[i] | sets[j]):
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), c := (least.get(find(i)) if sets[i] else d), d == c) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows, **how):
    got = near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string"), **how)
    return sorted([tuple(r) for r in got.collect()], key=str)


def family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(120)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = rng.choice(words)
        yield " ".join(own)


@pytest.mark.parametrize("k,threshold", [(3, (85, 100)), (5, (80, 100))])
def test_against_brute_force(spark, k, threshold):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdéf") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    texts = [t for n, e in ((2, 2), (70, 6), (90, 3), (5, 4), (12, 12)) for t in family(rng, words, n, e)]
    texts += ["", None, "a", "A", "a b", "a\tb", "\n", "one two three", *["same text here and there"] * 5, "x " * 3000]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(None, "a b"), (None, "only here in a null row"), (3, texts[3])]
    assert run(spark, rows, shingle=k, threshold=threshold) == brute(rows, k, *threshold)


@pytest.mark.parametrize("pivots,edits", [(16, 9), (1, 9), (2, 14), (16, 2)])
def test_families_in_blocks(spark, monkeypatch, pivots, edits):
    """Families of several blocks: all united by the pivots, some left apart, and most left apart; ids null or repeated."""
    from factloom.llm import near_dup

    monkeypatch.setattr(near_dup, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(near_dup, "PIVOTS", pivots)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdéf") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    texts = [*family(rng, words, 150, edits), *family(rng, words, 4, 1)]
    rows = [(None if i % 40 == 7 else i, t) for i, t in enumerate(texts)] + [(2, texts[60]), (2, texts[2])]
    assert run(spark, rows, shingle=3, threshold=(85, 100)) == brute(rows, 3, 85, 100)


def test_empty_table(spark):
    assert run(spark, []) == []
