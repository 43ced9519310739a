"""Scalar queries over whole texts against brute force."""

import html

from factloom.plans import registry

SF = "/root/testdata/sf0.001"


def test_escapes_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.csv, r.html) for r in registry.queries()["csv_html_escape"](spark, SF).collect()}
    assert len(got) == len(docs) and any(len(r.text or "") > 60 for r in docs)
    for r in docs:
        t = None if r.text is None else r.text + ('"q" <b>&' if r.doc_id % 3 == 0 else "")
        quoted = t and ('"' + t.replace('"', '""') + '"' if any(c in t for c in '",\n\r') else t)
        assert got[r.doc_id] == (quoted, t and html.escape(t).replace("&#x27;", "'"))
