"""Statistics against brute force, and the learned models on held-out rows."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import q_quality, quality_qda, quality_rules, text_stats

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORDS.search(x):
            dup += x in seen
            seen.add(x)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = {r: runs.count(r) for r in set(runs)}
    covered = {j for i, r in enumerate(runs) if times[r] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts():
    rng = random.Random(3)
    texts = [None, "", " \n\t\n", "a", "#a|b <é>\n\n#a|b <é>\n\x0b\nx\x1cy\x85z 😀", "same " * 30]
    texts += ["".join(rng.choice("aab é\n#|\t") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    at = [text_stats.COUNTS.index(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    for t in texts:
        got = text_stats.counts(None if t is None else t.encode())
        assert tuple(got[i] for i in at) == brute(t), t


def test_decision_list_finds_a_planted_rule():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] < 0.5)) | (x["c"] > 0.95)
    rules = quality_rules.learn(x, bad)
    hit = np.any([quality_rules._covers(r, x, 3000) for r in rules], axis=0)
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.02 * 3000


def test_one_class_teaches_nothing():
    x = {"a": np.arange(10.0)}
    assert quality_rules.learn(x, np.zeros(10, bool)) == [] and quality_rules.learn(x, np.ones(10, bool)) == []
    assert quality_qda.fit_model(np.zeros((3, 2)), np.ones(3)).score(np.zeros((1, 2)))[0] == 1.0
    assert quality_qda.fit_model(np.zeros((0, 2)), np.zeros(0)).prior == 0.5


def test_queries_on_whole_tables(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    rules = q_quality.op6_quality_rules(spark, d)
    assert rules.count() == 1000
    rows = rules.join(labels, "doc_id").collect()
    assert sum(not r.kept for r in rows if r.quality == 0) > 0.9 * sum(r.quality == 0 for r in rows)
    assert sum(not r.kept for r in rows if r.quality == 1) < 0.03 * len(rows)
    scored = q_quality.op7_quality_classifier(spark, d)
    assert scored.count() == 1000 and scored.where("score between 0 and 1").count() == 1000
    held = scored.where("held_out").join(labels, "doc_id").select((F.col("predicted") == F.col("quality")).alias("ok")).collect()
    assert np.mean([r.ok for r in held]) > 0.95


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a b", "x"), (2, "", "x"), (2, "", "x")], "doc_id long, text string, n_words string")
    stats = text_stats.statistics(docs)
    no_labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert quality_rules.fit(stats, no_labels) == []
    assert quality_rules.apply_rules(stats, []).where("kept").count() == 0
    assert quality_qda.score(stats, quality_qda.fit(stats, no_labels)).count() == 4
    assert text_stats.statistics(docs.where("false")).count() == 0
