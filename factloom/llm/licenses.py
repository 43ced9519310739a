"""License scans: phrases by place, and an exact set-similarity join of text blocks with license templates.

DataFrame functions only. Blocks are runs of BLOCK words of the whole text, every half block; lines don't bound them.
Templates of more than half a block have blocks of their own, twice, four times ... as long, so that a run of words as long
as a template always lies whole in one of its blocks, wherever it begins. A template is met by a block that holds at least the threshold's share of the template's distinct tokens. Tokens are ordered
globally, rarest first, by the number of documents that hold them; then each template is indexed by its prefix (the
shortest run of rarest tokens of which a match must hold one), texts that hold no prefix token and blocks that share none or
hold too few template tokens never reach the join, and the position of the first common token bounds the overlap before it
is counted. None of these filters loses a match.

Defined results: null text is empty and has no words; ASCII letters are lower-cased; overlapping places all count; a block
that meets several templates has all their labels. Repeated rows each get a row; a null doc_id is a row like any other.
Very long texts have as many blocks as they need. Other columns are ignored, whatever their names; an empty table gives no
rows, and an empty list of templates, or a template without words, no matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Words: ASCII digits and letters, and everything beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
BLOCK = 64
THRESHOLD = 0.8
#: Openings of well-known public licenses and notices, with their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
)


def words_of(text: Column) -> Column:
    """The words of a text, joined by single blanks."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, SEPARATORS, " "))


def _n_words(joined: Column) -> Column:
    return F.when(joined == "", F.lit(0)).otherwise(F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit(""))) + 1)


def phrase_counts(joined: Column) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and the array base_labels, from a text's joined words.

    Between doubled blanks every place of a phrase is a substring of its own, so that places are counted by what their
    removal leaves; the words before the first and after the last place give the positions.
    """
    wide = F.concat(F.lit(" "), F.replace(joined, F.lit(" "), F.lit("  ")), F.lit(" "))
    tight = F.concat(F.lit(" "), joined, F.lit(" "))
    n_words = _n_words(joined)
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES:
        spread, size = f" {phrase.replace(' ', '  ')} ", len(phrase.split())
        n = ((F.length(wide) - F.length(F.replace(wide, F.lit(spread), F.lit("")))) / len(spread)).cast("long")
        before = _n_words(F.trim(F.substring_index(tight, f" {phrase} ", 1)))
        after = _n_words(F.trim(F.substring_index(tight, f" {phrase} ", -1)))
        there = F.contains(tight, F.lit(f" {phrase} "))
        counts.append(F.when(there, n).otherwise(F.lit(0).cast("long")))
        firsts.append(F.when(there, before.cast("long")))
        lasts.append(F.when(there, (n_words - after - size).cast("long")))
        labels.append(F.when(there, F.lit(label)))
    return {
        "n_words": n_words.cast("long"),
        "n_base": sum(counts[1:], counts[0]),
        "first_word": F.least(*firsts),
        "last_word": F.greatest(*lasts),
        "base_labels": F.array_compact(F.array(*labels)),
    }


def _ranked_templates(docs: DataFrame, templates: tuple[tuple[str, str], ...]) -> tuple[list[str], dict[str, int]]:
    """The templates' tokens, rarest first by the number of documents that hold them (counted over all documents), and their ranks."""
    tokens = sorted({w for t, _ in templates for w in t.split()})
    held = F.array_intersect(F.split("joined", " "), F.array(*map(F.lit, tokens)))
    found = {r["token"]: r["n"] for r in docs.select(F.explode(held).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}  # at most one row per template token
    order = sorted(tokens, key=lambda w: (found.get(w, 0), w))
    return order, {w: i for i, w in enumerate(order)}


def block_length(template: str) -> int:
    """Words of the blocks that a template is held against: BLOCK, doubled until half a block holds the template."""
    n = len(template.split())
    return BLOCK << max(0, math.ceil(math.log2(max(2 * n, 1) / BLOCK)))


def template_matches(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_key, start (the block's first word), template, label and containment of every block that meets a template; docs has doc_key and text."""
    by_length: dict[int, list[tuple[int, str, str]]] = {}
    for k, (text, label) in enumerate(templates):
        if text.split():
            by_length.setdefault(block_length(text), []).append((k, text, label))
    if not by_length:
        return docs.where(F.lit(False)).select("doc_key", F.lit(0).alias("start"), F.lit(0).alias("template"), F.lit("").alias("label"), F.lit(0.0).alias("containment"))
    out = None
    for block, some in sorted(by_length.items()):
        found = _matches(docs, some, threshold, block)
        out = found if out is None else out.unionByName(found)
    return out


def _matches(docs: DataFrame, templates: list[tuple[int, str, str]], threshold: float, block: int) -> DataFrame:
    """The matches of templates (number, text, label) in blocks of one length."""
    spark = docs.sparkSession
    order, rank = _ranked_templates(docs.select(words_of(F.col("text")).alias("joined")), tuple((t, label) for _, t, label in templates))
    rows = []
    for k, text, label in templates:
        ranks = sorted({rank[w] for w in text.split()})
        need = math.ceil(threshold * len(ranks) - 1e-9)
        rows += [(k, label, ranks, len(ranks), need, r, i) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    fields = ("template", "label", "ranks", "size", "need", "token", "at")
    entry = lambda r: F.struct(*(F.array(*map(F.lit, x)).alias(n) if isinstance(x, list) else F.lit(x).alias(n) for n, x in zip(fields, r, strict=True)))
    index = spark.range(1).select(F.inline(F.array(*map(entry, rows))))
    prefix = sorted({r[5] for r in rows})
    least = min(r[4] for r in rows)
    # a text that holds no prefix token at all can meet no template
    some = "(?:^| )(?:" + "|".join(order[r] for r in prefix) + ")(?: |$)"
    texts = docs.select("doc_key", words_of(F.col("text")).alias("joined")).where(F.col("joined").rlike(some))
    texts = texts.select("doc_key", F.split("joined", " ").alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1 - block // 2, F.lit(0)), F.lit(block // 2))
    blocks = texts.select("doc_key", "words", F.explode(starts).alias("start")).select("doc_key", "start", F.slice("words", F.col("start") + 1, F.lit(block)).alias("words"))
    ranks_of = F.create_map(*[F.lit(x) for w, i in rank.items() for x in (w, i)])
    ranks = F.array_sort(F.transform(F.array_intersect("words", F.array(*map(F.lit, order))), lambda w: F.try_element_at(ranks_of, w)))
    blocks = blocks.select("doc_key", "start", ranks.alias("held")).where(F.size("held") >= least)
    probes = blocks.select("doc_key", "start", "held", F.posexplode("held").alias("j", "token"))
    # length and position: what may still follow the common token on either side, itself included
    small = F.broadcast(index)  # bounded: one row per prefix token of the declared templates
    near = probes.join(small, "token").where((F.size("held") >= F.col("need")) & (F.least(F.col("size") - F.col("at"), F.size("held") - F.col("j")) + F.least("at", "j") >= F.col("need")))
    near = near.withColumn("common", F.size(F.array_intersect("held", "ranks"))).where("common >= need")
    return near.select("doc_key", "start", "template", "label", (F.col("common") / F.col("size")).alias("containment")).distinct()


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, phrase counts, base_labels and labels (arrays, sorted and distinct) and score for each row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text")).withColumn("doc_key", F.struct("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n")))
    hits = template_matches(docs, templates, threshold).groupBy("doc_key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    hits = hits.select(F.col("doc_key").alias("hit_key"), "more", "best")
    base = docs.withColumn("joined", words_of(F.col("text")))
    base = base.select("doc_id", "doc_key", *(c.alias(k) for k, c in phrase_counts(F.col("joined")).items()))
    out = base.join(hits, F.col("doc_key").eqNullSafe(F.col("hit_key")), "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_sort("base_labels").alias("base_labels"), labels.alias("labels"), score.alias("score"))
