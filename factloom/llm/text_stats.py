"""Whole-text statistics of documents, one pass per text; the features of the quality rules and of the classifier.

Null text counts as empty, and every count of an empty text is 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factloom.llm.common import WordHashes, windows

#: Words in a window that is looked for again.
WINDOW = 5
COUNTS = ("n_bytes", "n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_digits", "n_marks", "n_short_words", "n_repeat_neighbours", "longest_word")
_WORDS = WordHashes()
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_DIGIT = np.isin(np.arange(256), list(range(48, 58)))
_MARK = np.isin(np.arange(256), [b for b in range(33, 127) if not chr(b).isalnum()]) & ~_SYMBOL
_TAIL = np.isin(np.arange(256), list(range(128, 192)))


def counts(text: bytes | None) -> tuple[int, ...]:
    """The values of COUNTS for a text in UTF-8."""
    text = text or b""
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = len(text) - int(n[_TAIL].sum())
    words = text.split()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    h = _WORDS.of(words)
    lines = Counter(x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c"))
    runs = windows(h, WINDOW)
    again = 0
    if len(runs):
        _, at, times = np.unique(runs, return_inverse=True, return_counts=True)
        (start,) = np.nonzero(times[at] > 1)
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, start, 1)
        np.add.at(step, start + WINDOW, -1)
        again = int((np.cumsum(step) > 0).sum())
    of_lines = sum(lines.values())
    return (
        *(len(text), chars, len(words), chars - int(n[_BLANK].sum()), int(n[_SYMBOL].sum()), of_lines, of_lines - len(lines), again, len(np.unique(h))),
        *(int(n[_UPPER].sum()), int(n[_DIGIT].sum()), int(n[_MARK].sum()), int((sizes < 4).sum()), int((h[1:] == h[:-1]).sum()), int(sizes.max(initial=0))),
    )


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            found = np.array([counts(t) for t in part.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in found.T)], ["doc_id", *COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS for each row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_stats, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def shares() -> dict[str, Column]:
    """Shares and means of the counts, 0 where there is nothing to divide by."""
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": over("word_chars", "n_words"),
        "longest": F.col("longest_word").cast("double"),
        "symbols": over("n_symbols", "n_words"),
        "dup_lines": over("n_dup_lines", "n_lines"),
        "repeats": over("n_repeat_words", "n_words"),
        "distinct": over("n_distinct_words", "n_words"),
        "upper": over("n_upper", "n_chars"),
        "digits": over("n_digits", "n_chars"),
        "marks": over("n_marks", "n_words"),
        "short": over("n_short_words", "n_words"),
        "neighbours": over("n_repeat_neighbours", "n_words"),
        "line_words": over("n_words", "n_lines"),
    }
