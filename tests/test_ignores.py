"""Ignore files against git's own judgement, on trees written by hand and by chance."""

import random
import shutil
import subprocess

import pytest

from factloom.sources import ignores as I

TREE = {
    ".gitignore": "# comment\n*.log\n!keep.log\n/build/\ndoc/**/*.txt\ntmp\n\\#odd\n\\!bang\ntrail \\ \n[ab]?.c\nfoo/*\n!foo/bar\n**/deep/x\nabc/**\n*.o\n\n/only\nq/r\n[!z]1\n",
    "lib/.gitignore": "!*.log\n*.pm\n!good.pm\nsub/\n",
    "lib/sub2/.gitignore": "!x.pm\n",
    "build/.gitignore": "!*\n",
}
FILES = ["a.log", "keep.log", "build/x", "build/keep.log", "lib/build/x", "doc/a.txt", "doc/p/a.txt", "doc/p/q/a.txt", "doc/a.md", "tmp", "x/tmp/y", "#odd", "!bang", "trail  ", "a1.c", "b2.c", "c3.c", "foo/bar/z", "foo/baz", "x/deep/x", "deep/x/y", "abc/w", "abc/x/y", "lib/a.log", "lib/a.pm", "lib/good.pm", "lib/sub/good.pm", "lib/sub2/x.pm", "lib/sub2/y.pm", "m.o", "only/x", "x/only", "q/r", "p/q/r", "y1", "z1", "k/y1"]


def written(root, tree, files):
    for name in files:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    for name, text in tree.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    every = sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file() and ".git/" not in str(p))
    out = subprocess.run(["git", "-C", str(root), "check-ignore", "--no-index", "-z", "--stdin"], input="\0".join(every) + "\0", capture_output=True, text=True).stdout
    shutil.rmtree(root / ".git")
    return every, sorted(x for x in out.split("\0") if x)


def by_chance(rng):
    names, bits = ["a", "b", "cc", "d.x", "e.x"], ["a", "b", "c*", "*.x", "?", "**", "*", "[ab]", "[!a]", "d.x"]
    files = {"/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(60)}
    files = [f for f in files if not any(g.startswith(f + "/") for g in files)]
    dirs = {""} | {f.rpartition("/")[0] + "/" for f in files if "/" in f}
    line = lambda: rng.choice(["", "", "!"]) + rng.choice(["", "", "/"]) + "/".join(rng.choice(bits) for _ in range(rng.choice([1, 1, 2, 3]))) + rng.choice(["", "", "/"])
    return {f"{d}.gitignore": "\n".join(line() for _ in range(rng.randint(1, 5))) for d in rng.sample(sorted(dirs), min(4, len(dirs)))}, files


@pytest.mark.skipif(shutil.which("git") is None, reason="git judges")
def test_like_git(spark, tmp_path):
    cases = [(TREE, FILES), *(by_chance(random.Random(s)) for s in range(12))]
    paths, texts, want = [], [], []
    for n, (tree, files) in enumerate(cases):  # each tree is a directory of its own, and all are judged in one go
        root = tmp_path / f"t{n}"
        root.mkdir()
        every, gone = written(root, tree, files)
        paths += [(f"t{n}/{p}",) for p in every]
        texts += [(f"t{n}/{p}", t) for p, t in tree.items()]
        want += [f"t{n}/{p}" for p in gone]
    got = I.ignored(spark.createDataFrame(paths, "path string"), I.rules(spark.createDataFrame(texts, "path string, text string"))).collect()
    assert sorted(r.path for r in got) == sorted(want) and len(want) > 50


def test_scan(spark, tmp_path):
    for name, text in {"a.pm": "x", "b.log": "y", "sub/c.pl": "zz", ".ignore": "*.log\n", "sub/.ignore": "big*\n!*.log\n", "sub/d.log": "l", "sub/big.pm": "b", "large.pm": "l" * 100}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    files, dropped = I.scan_heeding(spark, str(tmp_path), 50)
    got = {r.path: (r.lang, bytes(r.content)) for r in I.contents(files, str(tmp_path)).collect() if not r.path.endswith(".ignore")}
    assert got == {"a.pm": ("perl", b"x"), "sub/c.pl": ("perl", b"zz"), "sub/d.log": (None, b"l")}
    assert [r.path for r in dropped.collect()] == ["large.pm"]


def test_no_rules(spark):
    paths = spark.createDataFrame([("a",), ("b/c",)], "path string")
    assert I.ignored(paths, I.rules(spark.createDataFrame([("x/.gitignore", None), (".gitignore", "\n# x\n[\n\\\n!\n/\n")], "path string, text string"))).count() == 0
