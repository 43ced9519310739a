"""WARC round trips and chat formatting, against their definitions."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from factloom.llm import chat, q_records, warc


def page_rows():
    big, small = "<p>" + "ä" * 100 + "</p>", "tiny"
    return [(5, "http://a/\r\nX: y", big), (3, None, big), (9, "http://b", big), (7, "u", small), (8, "u", small), (1, "u", None), (None, "u", big), (2, "u", ""), (3, "again", big), (4, "u", "long " * 400_000), (6, "u", "a\r\n\r\nWARC/1.1\r\n\r\nContent-Length: 3" * 9)]


def test_round_trip(spark):
    rows = page_rows()
    got = warc.read_archives(warc.write_archives(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string"))).collect()
    least = {}
    for p, _, h in rows:
        if h and len(h.encode()) >= 100 and p is not None:
            least[h] = min(p, least.get(h, p))
    want = [(p, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), least[h] if h in least and p != least[h] else None) for p, _, h in rows]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert r.record_type == ("response" if r.refers_to is None else "revisit")
        assert (r.payload is None) == (r.refers_to is not None)
    assert {r.url for r in got if r.page_id == 5} == {"http://a/%0D%0AX: y"}


def test_files_and_corruption(spark, tmp_path):
    data = b"".join(warc.record(i, "u", b"x" * (i * 70_000), None, "2024-01-01T00:00:00Z") for i in range(4))
    (tmp_path / "a.warc.gz").write_bytes(data)
    got = warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(i, i * 70_000) for i in range(4)]
    raw = zlib.decompress(warc.record(1, "u", b"hello world", None, "2024-01-01T00:00:00Z"), 31)
    for bad in (raw.replace(b"hello", b"jello"), raw[:-1], raw + b"!", b"junk\r\n\r\n"):
        with pytest.raises(warc.CorruptRecord):
            warc.parse(iter([bad]))
    with pytest.raises(warc.CorruptRecord):
        [warc.parse(p) for p in warc.members(data[:-5])]


def test_empty_pages(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


TEXTS = st.text(st.sampled_from("\\#</turn>\nhl: aé😀"), max_size=30)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3) | st.none(), st.sampled_from(["user", "assistant", "system", "tool: x", "", None]), TEXTS | st.none()), max_size=40))
def test_chats_read_back(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    out = chat.format_chats(df)
    got = out.select("conv_id", chat.read_chats(F.col("formatted")).alias("turns"), chat.learned_text(F.col("segments")).alias("learned"), "formatted", "segments").collect()
    want = {}
    for c, n, r, t in rows:
        want.setdefault(c, []).append((-1 if n is None else n, r or "", t or ""))
    assert {r.conv_id: [tuple(x) for x in r.turns] for r in got} == {c: [x[1:] for x in sorted(v)] for c, v in want.items()}
    for r in got:
        assert r.learned == "".join(x[2] for x in sorted(want[r.conv_id]) if x[1] == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted


def test_turn_order(spark):
    talks = {1: ["user", "assistant"], 2: ["system", "user", "assistant", "user"], 3: ["assistant"], 4: ["user", "user"], 5: ["user", "tool"]}
    df = spark.createDataFrame([(c, i, r, "t") for c, rs in talks.items() for i, r in enumerate(rs)], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: (r.n_illegal, r.valid) for r in chat.format_chats(df).collect()} == {1: (0, True), 2: (0, True), 3: (1, False), 4: (1, False), 5: (1, False)}
    assert chat.format_chats(df.where("false")).count() == 0


def test_machine_is_in_the_plan(spark):
    plan = q_records.op10_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda legal" in plan or "legal" in plan and "aggregate(" in plan


def test_long_conversation(spark):
    turns = spark.range(20_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text")
    (r,) = chat.format_chats(turns).select("n_turns", "valid", F.size("segments").alias("n")).collect()
    assert (r.n_turns, r.valid, r.n) == (20_000, True, 60_000)
