"""Macros: each case by hand, whole texts, and every offset of a result back to where it stood."""

import random
import re

import pytest

from factloom.operators import macros as M

CASES = {
    "object": ("#define N 7\nint a = N;", "int a = 7;"),
    "nested": ("#define A B + B\n#define B 2\nx = A;", "x = 2 + 2;"),
    "function": ("#define SQ(x) ((x) * (x))\ny = SQ(a + 1);", "y = ((a + 1) * (a + 1));"),
    "nested call": ("#define SQ(x) ((x)*(x))\ny = SQ(SQ(b));", "y = ((((b)*(b)))*(((b)*(b))));"),
    "mutual": ("#define P Q\n#define Q P\nz = P + Q;", "z = P + Q;"),
    "self": ("#define f(x) f(x + 1)\nf(f(2));", "f(f(2 + 1) + 1);"),
    "before definition": ("a = N;\n#define N 1\nb = N;\n#undef N\nc = N;", "a = N;\n#define N 1\nb = 1;\n#undef N\nc = N;"),
    "redefined": ("#define N 1\na = N;\n#define N 2\nb = N;", "b = 2;"),
    "body at use": ("#define A B\n#define B 1\n#undef B\n#define B 5\nq = A;", "q = 5;"),
    "string and comment": ('#define N 1\ns = "N"; // N\n/* N */ t = \'N\';', "/* N */ t = 'N';"),
    "raw string": ('#define N 1\ns = R"x(N ")" N)x"; u = N;', 's = R"x(N ")" N)x"; u = 1;'),
    "paste": ("#define CAT(a, b) a ## b\nint CAT(x, 1) = 0;", "int x1 = 0;"),
    "paste makes a macro": ("#define CAT(a, b) a##b\n#define xy 9\nint v = CAT(x, y);", "int v = 9;"),
    "stringify": ('#define S(x) #x\nputs(S(a "b" + c));', 'puts("a \\"b\\" + c");'),
    "variadic": ("#define LOG(f, ...) printf(f, __VA_ARGS__)\nLOG(a, b, c(d, e));", "printf(a, b, c(d, e));"),
    "no arguments": ("#define F(x) [x]\nint (*p)(int) = F;", "int (*p)(int) = F;"),
    "empty": ("#define API\nAPI int f();", " int f();"),
    "continued": ("#define T(x) \\\n  do { x; } \\\n  while (0)\nT(go());", "do { go(); }    while (0);"),
    "over lines": ("#define G(a, b) a-b\nr = G(1,\n  2);", "r = 1-2;"),
    "comma in brackets": ("#define ONE(a) <a>\nONE((1, 2));", "<(1, 2)>;"),
    "unclosed": ("#define F(x) [x]\nF(1;", "F(1;"),
    "off": ("#define N 1\n#ifdef OFF\n#define N 2\n#else\n#define M 3\n#endif\nv = N + M;", "v = 1 + 3;"),
    "nested off": ("#define N 1\n#ifdef OFF\n#ifdef ANY\n#undef N\n#endif\n#undef N\n#endif\nv = N;", "v = 1;"),
    "on": ("#ifndef ON\n#define N 1\n#elif defined(ON)\n#define N 2\n#else\n#define N 3\n#endif\nv = N;", "v = 2;"),
    "zero": ("#if 0\n#define N 1\n#endif\nv = N;", "v = N;"),
    "guard": ("#ifndef G\n#define G\n#define N 4\n#endif\nv = N;", "v = 4;"),
    "number": ("#define e9 0\nv = 1e9 + e9 + 0xe9 + 1'000;", "v = 1e9 + 0 + 0xe9 + 1'000;"),
    "wide": ("#define N \U0001f600\nv = \U0001f600 + N + N;", "v = \U0001f600 + \U0001f600 + \U0001f600;"),
}


def _files(spark, rows):
    return spark.createDataFrame(rows, "file_id long, path string, text string")


def test_cases(spark):
    names = sorted(CASES)
    files = _files(spark, [(k, f"{k}.c", CASES[n][0]) for k, n in enumerate(names)] + [(900, "null.c", None), (901, "empty.c", ""), (902, "plain.c", "int a;")])
    made = M.splices(files, {"OFF": False, "ON": True})
    got = {r.file_id: r.text for r in M.applied(files, made).collect()}
    assert {n: got[k].rsplit("\n", 1)[-1] if "\n" not in CASES[n][1] else got[k] for k, n in enumerate(names)} == {n: CASES[n][1] for n in names}
    assert got[900] is None and got[901] == "" and got[902] == "int a;"


def test_headers(spark):
    files = _files(spark, [
        (1, "src/a.c", '#include "n.h"\n#include <sys/deep.h>\n#define LOCAL FAR\nv = NEAR + LOCAL + BOTH + GONE;'),
        (2, "src/n.h", '#include "sys/deep.h"\n#define NEAR MID(1)\n#define BOTH near\n#define GONE 1\n#undef GONE\n'),
        (3, "sys/deep.h", '#include "src/n.h"\n#define FAR 8\n#define MID(x) x * FAR\n#define BOTH deep\n'),
        (4, "b.c", "v = NEAR;"),
    ])
    got = {r.file_id: r.text.rsplit("\n", 1)[-1] for r in M.applied(files, M.splices(files)).collect()}
    assert got[1] == "v = 1 * 8 + 8 + near + GONE;" and got[4] == "v = NEAR;"


def test_no_tables_and_no_blowup(spark):
    assert M.splices(_files(spark, [])).count() == 0
    doubling = "".join(f"#define D{k} D{k + 1} D{k + 1}\n" for k in range(40)) + "x = D0; y = D39;"
    rows = M.splices(_files(spark, [(1, "a.c", doubling)])).orderBy("start").collect()
    assert [(r.name, r.text, r.too_long) for r in rows] == [("D0", "D0", True), ("D39", "D40 D40", False)]


def test_extra_columns(spark):
    files = _files(spark, [(1, "a.c", "#define N 1\nN")]).selectExpr("*", "1 as at", "2 as kind", "3 as i", "4 as name")
    assert [r.text for r in M.splices(files).collect()] == ["1"]


def _by_hand(text, made):
    """Every offset of the result with the offset it comes from, by walking the splices in order."""
    out, pos = [], 0
    for s in sorted(made, key=lambda s: s.start):
        out += range(pos, s.start)
        for p in s.pieces:
            out += range(p.origin, p.origin + len(p.text)) if p.exact else [p.origin] * len(p.text)
        pos = s.end
    return out + list(range(pos, len(text) + 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_offsets_lead_back(spark, seed):
    rng = random.Random(seed)
    defs = "#define A 12\n#define E\n#define F(x) <x|x>\n#define G(x, y) y F(x) A\n"
    texts = {k: defs + "".join(rng.choice(["A", "E", "F(q)", "G(ab, F(c))", " ", "zz", "\n", "(A)", "E E"]) + rng.choice([" ", ";", " A "]) for _ in range(40)) for k in range(6)}
    files = _files(spark, [(k, f"{k}.c", t) for k, t in texts.items()])
    made = M.splices(files).cache()
    by = {}
    for s in made.collect():
        by.setdefault(s.file_id, []).append(s)
    done = {r.file_id: r.text for r in M.applied(files, made).collect()}
    points = spark.createDataFrame([(k, p) for k, t in done.items() for p in range(len(t) + 1)], "file_id long, pos long")
    got = {(r.file_id, r.pos): r.original for r in M.origins(points, made).collect()}
    for k, t in texts.items():
        assert [got[k, p] for p in range(len(done[k]) + 1)] == _by_hand(t, by[k])
        for s in by[k]:
            for p in s.pieces:
                assert not p.exact or t[p.origin:p.origin + len(p.text)] == p.text  # what is exact stands there


def test_maps_compose(spark):
    files = _files(spark, [(1, "a.c", "#define A BB\nx A y A z")])
    first = M.splices(files)
    mid = M.applied(files, first)
    # a second pass over the result: its definitions are in front, so offsets shift again
    again = mid.selectExpr("file_id", "'a.c' as path", "concat('#define BB 12345\\n', text) as text")
    second, front = M.splices(again), len("#define BB 12345\n")
    end = M.applied(again, second).first().text
    points = spark.createDataFrame([(1, m.start()) for m in re.finditer("[xyz]", end)], "file_id long, pos long")
    there = M.origins(points, second).selectExpr("file_id", "original - %d as pos" % front)
    back = sorted(r.original for r in M.origins(there, first).collect())
    text = files.first().text
    assert [text[k] for k in back] == ["x", "y", "z"]
