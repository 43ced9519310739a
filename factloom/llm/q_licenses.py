"""Query of the license scan and its oracle, which compares every block with every template."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm import licenses
from factloom.llm.common import table


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase places, labels and score of every document."""
    out = licenses.scan(table(spark, sf_dir, "documents"))
    return out.withColumn("base_labels", F.array_join("base_labels", ",")).withColumn("labels", F.array_join("labels", ","))


def _oracle() -> str:
    low = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = lambda c: rf"regexp_extract_all({c}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    places = []
    for phrase, label in licenses.PHRASES:
        w = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(w))
        places.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {test}), lambda i: {{'at': i - 1, 'label': '{label}'}})")
    templates = ", ".join(f"({i}, '{label}', list_distinct(string_split('{t}', ' ')))" for i, (t, label) in enumerate(licenses.TEMPLATES))
    half = licenses.BLOCK // 2
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {low("coalesce(text, '')")} AS low FROM documents),
w AS (SELECT rid, doc_id, {words("low")} AS w FROM d),
p AS (SELECT *, list_concat({", ".join(places)}) AS places FROM w),
t(k, label, toks) AS (VALUES {templates}),
b AS (SELECT rid, list_distinct(w[s + 1 : s + {licenses.BLOCK}]) AS w
      FROM (SELECT rid, w, unnest(range(0, greatest(len(w) - 1 - {half}, 0) + 1, {half})) AS s FROM p WHERE len(w) > 0)),
h AS (SELECT rid, label, len(list_intersect(w, toks)) / len(toks) AS c FROM b, t
      WHERE len(list_intersect(w, toks)) >= ceil({licenses.THRESHOLD} * len(toks) - 1e-9)),
a AS (SELECT rid, list(DISTINCT label) AS more, max(c) AS best FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base,
  list_min(list_transform(places, lambda x: x.at))::BIGINT AS first_word, list_max(list_transform(places, lambda x: x.at))::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x.label))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform(places, lambda x: x.label), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM p LEFT JOIN a USING (rid)
"""


QUERIES = {"op8_licenses": op8_licenses}
ORACLES = {"op8_licenses": _oracle()}
