"""Template matching over whole texts against brute force, with notices wrapped as files wrap them."""

import math
import random
import re

import pytest

from factloom.llm import licenses

WRAPPED = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\")", "mit"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:", "bsd"),
    ("you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at", "apache-2"),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by", "gpl"),
)


def brute(text):
    """(labels, best containment) of the half-overlapping blocks of a text's words."""
    words = [w for w in re.split(licenses.SEPARATORS, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    half, labels, best = licenses.BLOCK // 2, set(), 0.0
    for s in range(0, max(len(words) - 1 - half, 0) + 1, half):
        held = set(words[s : s + licenses.BLOCK])
        for template, label in licenses.TEMPLATES:
            tokens = set(template.split())
            common = len(held & tokens)
            if common >= math.ceil(licenses.THRESHOLD * len(tokens) - 1e-9):
                labels.add(label)
                best = max(best, common / len(tokens))
    return labels, best


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licenses.scan(docs).collect()}


@pytest.mark.parametrize("prefix", ["", "# ", " * "])
def test_wrapped_notices_keep_their_labels(spark, prefix):
    texts = [prefix + t.replace("\n", "\n" + prefix) for t, _ in WRAPPED]
    got = scanned(spark, texts)
    for i, (_, label) in enumerate(WRAPPED):
        assert label in got[i].labels and got[i].score >= licenses.THRESHOLD


def test_blocks_against_brute_force(spark):
    rng = random.Random(8)
    fill = lambda n: [rng.choice(("lorem", "ipsum", "the", "license", "of", "is", "4", "é")) for _ in range(n)]
    texts = [None, "", "\n \n", "0"]
    for _ in range(120):
        words = fill(rng.randint(0, 150))
        for template, _ in rng.sample(licenses.TEMPLATES, rng.randint(1, 2)):
            said = [w for w in template.split() if rng.random() < 0.93]
            words += said + fill(rng.randint(0, 80))
        texts.append("".join(w + rng.choice((" ", " ", " ", "\n", "\n# ", ", ")) for w in words))
    got = scanned(spark, texts)
    met = 0
    for i, text in enumerate(texts):
        labels, best = brute(text)
        met += bool(labels)
        assert set(got[i].labels) - set(got[i].base_labels) == labels - set(got[i].base_labels), text
        if not got[i].n_base:
            assert got[i].score == pytest.approx(best), text
    assert 60 < met < len(texts)


@pytest.mark.parametrize("n", [30, 33, 61, 80, 100, 400])
def test_templates_of_any_length(spark, n):
    template = " ".join(f"t{i}" for i in range(n))
    short = "alpha beta gamma delta epsilon"
    rows = [(at, " ".join(["pad"] * at + [template] + ["tail"] * 7)) for at in (0, 1, 17, 31, 32, 47, 63, 64, 100)] + [(-1, " ".join(template.split()[: n // 2])), (-2, "x " * 300 + short), (None, None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), ((template, "long"), (short, "short"))).collect()
    assert {r.doc_id: r.labels for r in got} == {d: ["long"] if d is not None and d >= 0 else ["short"] if d == -2 else [] for d, _ in rows}


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "released under the mit license", "x", "y", 3)] * 2 + [(None, None, "x", "y", 3), (2, "word " * 50_000, "x", "y", 3)], "doc_id long, text string, label string, words string, start int")
    assert sorted((str(r.doc_id), r.labels) for r in licenses.scan(df).collect()) == [("1", ["mit"]), ("1", ["mit"]), ("2", []), ("None", [])]
    assert sorted(r.labels for r in licenses.scan(df, ()).collect()) == [[], [], ["mit"], ["mit"]]  # the phrases stay
    assert [r.score for r in licenses.scan(df, (("  ", "none"),)).where("doc_id = 2").collect()] == [0.0]
    assert licenses.scan(df.limit(0)).count() == 0
