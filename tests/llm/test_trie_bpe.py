"""Trie BPE against the tokenizers library."""

import numpy as np
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from factloom.llm.q_text import vocabulary
from factloom.llm.trie_bpe import TrieBpe, encode

PATH = vocabulary("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OURS = TrieBpe(PATH)
ODD = ["", "a<|endoftext|> b <|ENDOFTEXT|>x", "日本語 test ☃☃☃!!??", "İΣΑΣ ẞ ﬁ é é", "x" * 5000 + "!", "'s 're don't I'LL '' 12³½ ٣", "‍ ﻿　a\x00b\x1c\x85c", "😀😃 a😀", " ", "\x1c", "<|startoftext|><|endoftext|>"]


def expected(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abcdeinorst'!?1 \n\té<|>"), st.characters(max_codepoint=0x24FF, exclude_categories=["Cs", "Cn"]))), max_size=4))
def test_random_texts(texts):
    for text, (ids, decoded) in zip(texts, OURS.encode_texts(texts), strict=True):
        assert (np.frombuffer(ids, "<u4").tolist(), decoded) == expected(text)


def test_table_with_odd_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(1, ODD[1], "x"), (None, None, "x")]
    got = encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH).collect()
    want = [(d, *expected(t or "")) for d, t, _ in rows]
    assert sorted(((r[0], np.frombuffer(r[1], "<u4").tolist(), r[2]) for r in got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
