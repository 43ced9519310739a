"""Decontamination against alignment without filters."""

import random

import numpy as np

from factloom.llm import decontaminate as dc, q_passages


def distance(pattern, text):
    """Least edits of the pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        s[i : i + 1] = rng.choice([[], [rng.choice("abc ")], [s[i], rng.choice("abc")]])
    return "".join(s)


def test_no_match_is_lost():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    said = lambda k: " ".join(word() for _ in range(k))
    items = [(i, said(rng.randint(2, 40))) for i in range(12)] + [(90, "tiny"), (91, None), (92, "")]
    index = dc.build([x for x in items if x[1] is not None])
    assert (index.needed >= 1).all()
    texts = [said(rng.randint(0, 30)) + " " + edited(rng, rng.choice(items[:12])[1], rng.randint(0, 9)) + " " + said(rng.randint(0, 30)) for _ in range(60)] + ["", "x"]
    texts = [dc.normalized(t) for t in texts]
    got = {(x, item) for x, item, *_ in dc.matches(texts, index)}
    want = set()
    for x, t in enumerate(texts):
        for p, item, k in zip(index.patterns, index.pattern_item, index.edits, strict=True):
            if distance("".join(map(chr, p)), t) <= k:
                want.add((x, int(item)))
    assert got == want and len(want) > 30


def test_query_finds_whole_items(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, dc.normalized(r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, dc.normalized(r.text)) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in q_passages.op2_decontamination(spark, d).collect()}
    assert {(a, b) for a, t in docs for b, s in items if s in t} <= got and got


def test_items_shorter_than_a_gram():
    items = [(1, "a b"), (2, "tiny"), (3, "!!"), (4, "b"), (5, "tiny ab")]
    index = dc.build(items)
    texts = ["a b a b", "tiny", "tinyb atiny", "x tiny ab", "", "A-B? tiny".lower()]
    got = {(x, index.items[item], a, b) for x, item, a, b, _ in dc.matches([dc.normalized(t) for t in texts], index)}
    want = {(x, i, a, a + len(p)) for x, t in enumerate(map(dc.normalized, texts)) for i, s in items if (p := dc.normalized(s)) for a in range(len(t)) if f" {t} "[a : a + len(p) + 2] == f" {p} "}
    assert got == want and len(want) == 10


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "The quick brown fox, jumps over THE lazy dog again", "x"), (1, None, "x"), (None, "another passage that is long enough", "x"), (3, "short", "x")], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(1, "so the quick brown fox jumps over the lazy dog again!", 0), (1, "so the quick brown fox jumps over the lazy dog again!", 0), (2, None, 0), (3, "", 0), (None, "another  passage that is\nlong enuogh", 0), (4, "short", 0)], "doc_id long, text string, item_id int")
    got = sorted(((r.doc_id, r.item_id) for r in dc.contaminated(docs, bench).collect()), key=str)
    assert got == [(1, 1), (1, 1), (4, 3), (None, None)]
    assert dc.contaminated(docs, bench.where("false")).count() == 0 == dc.contaminated(docs.where("false"), bench).count()
    assert np.array_equal(dc.grams(np.zeros(3, np.uint32)), [])
