"""Ignore-aware walks against git itself where it is there, and against a plain walk."""

import os
import random
import shutil
import subprocess

import pytest

from tarnwork.sources import tree


@pytest.mark.parametrize("rule,yes,no", [
    ("*.log", ["a.log", "x/b.log"], ["a.logs", "log"]), ("/a", ["a"], ["x/a"]), ("a/b", ["a/b"], ["x/a/b"]), ("build/", ["build", "x/build"], ["builds"]), ("**/c", ["c", "x/y/c"], ["cc"]),
    ("a/**", ["a/b", "a/b/c"], ["a"]), ("a/**/z", ["a/z", "a/b/c/z"], ["az"]), ("x?z", ["xyz"], ["x/z", "xz"]), ("[ab].t", ["a.t", "b.t"], ["c.t"]), ("[!ab].t", ["c.t"], ["a.t"]), ("\\#x", ["#x"], ["x"]), ("a+b.c", ["a+b.c"], ["aab.c"]), ("n  ", ["n"], ["n  "]),
])
def test_rules(spark, rule, yes, no):
    _, _, pattern = tree.rule_of(rule)
    rows = spark.createDataFrame([(x,) for x in yes + no], "p string")
    assert {x["p"] for x in rows.where(rows.p.rlike(pattern)).collect()} == set(yes)
    assert tree.rule_of("# no") is None and tree.rule_of("   ") is None and tree.rule_of("!a/")[:2] == (True, True)


def grow(root, seed):
    """A tree with ignore files on three levels."""
    r = random.Random(seed)
    names = ["a", "b", "log", "tmp", "keep.txt", "x.log", "y.txt", "z.py", "build"]
    for _ in range(120):
        parts = [r.choice(["a", "b", "log", "tmp", "build", "src"]) for _ in range(r.randint(0, 3))] + [r.choice(names) + r.choice(["", ".o", ".c"])]
        path = os.path.join(root, *parts)
        if any(os.path.isfile(os.path.join(root, *parts[:k])) for k in range(1, len(parts))) or os.path.isdir(path):
            continue
        os.makedirs(os.path.dirname(path), exist_ok=True)
        open(path, "w").write("x")
    for folder, _, _ in list(os.walk(root)):
        if folder == root or r.random() < 0.4:
            rules = r.sample(["*.log", "!x.log", "build/", "/tmp", "a/b", "*.o", "!keep.txt.o", "**/log", "src/**", "!src/a", "# note", "", "*.txt", "!y.txt"], 4)
            open(os.path.join(folder, ".gitignore"), "w").write("\n".join(rules) + "\n")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_walk_agrees_with_git(spark, tmp_path, seed):
    if shutil.which("git") is None:
        pytest.skip("no git")
    root = str(tmp_path / "w")
    os.makedirs(root)
    grow(root, seed)
    subprocess.run(["git", "init", "-q", root], check=True)
    out = subprocess.run(["git", "-C", root, "-c", "core.excludesFile=/dev/null", "ls-files", "-o", "--exclude-standard"], capture_output=True, text=True, check=True).stdout
    shutil.rmtree(os.path.join(root, ".git"))
    got = [x["path"] for x in tree.workspace(spark, root).orderBy("place").collect()]
    assert set(got) == {x for x in out.split("\n") if x and not x.endswith(".gitignore")} and len(got) > 5
    assert got == sorted(got, key=lambda p: (p.count("/"), p.split("/")[:-1], p.split("/")[-1]))  # breadth first


def test_include_exclude_and_scope(spark):
    files = spark.createDataFrame([(p, 1) for p in ("a.py", "a.txt", "src/b.py", "src/node_modules/c.py", "src/sub/d.py", "lib/e.py")], "path string, size int")
    none = spark.createDataFrame([], "path string, content string")
    paths = lambda **o: {x["path"] for x in tree.walk(files, none, **o).collect()}
    assert paths() == {x["path"] for x in files.collect()}
    assert paths(include=("*.py",), exclude=("node_modules/",)) == {"a.py", "src/b.py", "src/sub/d.py", "lib/e.py"}
    assert paths(scope=("src/sub", "a.py")) == {"src/sub/d.py", "a.py"} and paths(scope=()) == set()
    assert tree.walk(files.limit(0), none).count() == 0
