"""The pipeline on a small table, stage by stage against brute force."""

import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from factloom.llm import decontaminate
from factloom.llm.q_text import vocabulary
from tests.llm.test_near_dup import brute as near_brute
from tests.llm.test_suffix_dedup import brute as passage_brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    d = str(tmp_path_factory.mktemp("sf"))
    sound = {"en": ["the", "ing", "tion", "and", "er", "ou"], "fr": ["eau", "le", "é", "oi", "ment", "que"]}
    said = lambda x, k: " ".join("".join(rng.choice(sound[x]) for _ in range(rng.randint(1, 4))) for _ in range(k))
    items = [(i, said("en", 25)) for i in range(3)]
    shared = said("en", 60)
    texts = [(x, said(x, rng.randint(30, 90))) for x in ("en", "fr") for _ in range(25)]
    texts += [("en", texts[2][1]), ("en", texts[3][1] + " extra"), ("en", said("en", 20) + " " + items[1][1]), ("en", said("en", 30) + " " + shared), ("en", shared + " " + said("en", 30)), ("en", "12345 !!"), ("fr", None), (None, said("fr", 40)), ("en", "")]
    rows = [(i, t, x, "s", len(t or "")) for i, (x, t) in enumerate(texts)]
    rows += [rows[5]]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, items


def test_stages(spark, folder):
    d, rows, items = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = [tuple(r) for r in cp.language_id(spark, docs, d).collect()]
    want = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    assert sorted(got) == sorted(want, key=lambda r: r[0]) or {r[0] for r in got} == {r[0] for r in want}

    step = spark.createDataFrame(got, SCHEMA)
    out = [tuple(r) for r in cp.near_dedup(spark, step, d).collect()]
    kept = {r[0] for r in near_brute([r[:2] for r in got], 5, 80, 100) if r[3]}
    assert sorted(r[0] for r in out) == sorted(kept) and set(out) <= set(got)

    after = [tuple(r) for r in cp.passage_dedup(spark, spark.createDataFrame(out, SCHEMA), d).collect()]
    left = {x: b.decode("utf-8", "ignore") for x, b, _ in passage_brute([r[:2] for r in out])}
    assert {r[0]: r[1] for r in after} == left and all(r[4] == len(r[1]) for r in after) and left != {r[0]: r[1] for r in out}

    clean = [tuple(r) for r in cp.decontamination(spark, spark.createDataFrame(after, SCHEMA), d).collect()]
    leaks = {r[0] for r in after if any(decontaminate.normalized(t) in decontaminate.normalized(r[1]) for _, t in items)}
    assert leaks and {r[0] for r in clean} == {r[0] for r in after} - leaks

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    encoded = cp.tokens(spark, spark.createDataFrame(clean, SCHEMA), d).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in encoded} == {r[0]: library.encode(r[1], add_special_tokens=False).ids for r in clean}

    whole = cp.run(spark, d).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in whole) == sorted((r.doc_id, r.ids_sha256) for r in encoded)


def test_odd_rows(spark, tmp_path):
    rows = [(None, "the same words again and again in here", "en", None, None), (None, None, None, None, None), (1, "the same words again and again in here", "en", "s", 3), (2, "", "fr", "s", 0)]
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for some in (rows, []):
        docs = spark.createDataFrame(some, SCHEMA)
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == (1 if some else 0)  # the row without a doc_id is a copy of document 1


def test_rows_without_or_under_one_id(spark, tmp_path):
    rng = random.Random(3)
    said = lambda k: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(k))
    item, a, b, c = said(25), said(40), said(40), said(40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(7, a, "en", "s", 1), (7, b, "en", "s", 1), (7, b, "en", "s", 1), (8, a, "en", "t", 1), (None, b, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "s", 1), (None, said(9) + " " + item, "en", "s", 1), (9, "", "en", "s", 1), (9, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    near = cp.near_dedup(spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    assert sorted((tuple(r)[:2] for r in near.collect()), key=str) == sorted([(7, a), (7, b), (None, c), (None, rows[7][1]), (9, ""), (9, "")], key=str)
    assert sorted((tuple(r)[:2] for r in cp.decontamination(spark, docs, str(tmp_path)).collect()), key=str) == sorted((r[:2] for r in rows if r is not rows[7]), key=str)
