"""Decontamination finds every excerpt of the stated least length, from every offset of every item."""

import random

from factloom.llm import decontaminate as dc

SF = "/root/testdata/sf0.001"


def missed(spark, size, at_words):
    items = [(r.item_id, dc.normalized(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()][:60]
    rng = random.Random(6)
    items += [(-1, "".join(rng.choice("天地玄黄宇宙洪荒日月盈昃") for _ in range(200)))]
    index = dc.build(items)
    texts, want = [], []
    for k, (_, text) in enumerate(items):
        for o in range(len(text) - size + 1):
            if not at_words or o == 0 or text[o - 1] == " ":
                texts.append(dc.normalized(f"zq xv {text[o : o + size]} wk jp"))
                want.append(k)
    assert len(texts) > 100
    got = {(x, item) for x, item, *_ in dc.matches(texts, index)}
    return [(x, k) for x, k in enumerate(want) if (x, k) not in got]


def test_from_every_word(spark):
    assert not missed(spark, 60, True)


def test_from_every_character(spark):
    assert not missed(spark, 69, False)
