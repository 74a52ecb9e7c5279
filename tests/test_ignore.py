"""Ignore rules against what git itself leaves out."""

import random
import subprocess

import pytest
from inkgraph.sources import ignore

PIECES = ["a", "b.md", "a*", "*.md", "?", "a?c", "[ab]*", "[!a]*", "d+e", "x y", "**", "f(1)", "a\\*b", "{z}"]
NAMES = ["a", "b", "b.md", "abc", "a.md", "d+e", "x y", "f(1)", "a*b", "c", "{z}"]


def rule(rng):
    if rng.random() < 0.1:
        return rng.choice(["", "# a", "  ", "/", "\\#x", "\\!a"])
    body = "/".join(rng.choice(PIECES) for _ in range(rng.choice([1, 1, 1, 2, 2, 3])))
    return rng.choice(["", "", "!"]) + rng.choice(["", "", "/"]) + body + rng.choice(["", "", "/"])


@pytest.mark.parametrize("seed", range(6))
def test_as_git(spark, tmp_path, seed):
    rng = random.Random(seed)
    files = {}
    for _ in range(60):
        path = "/".join(rng.choice(NAMES) for _ in range(rng.randrange(1, 5)))
        if not any(p.startswith(path + "/") or path.startswith(p + "/") for p in files):
            files[path] = "x"
    dirs = sorted({"", *("/".join(p.split("/")[:i]) for p in files for i in range(1, p.count("/") + 1))})
    for d in rng.sample(dirs, min(4, len(dirs))):
        files[f"{d}/.gitignore".lstrip("/")] = "\n".join(rule(rng) for _ in range(rng.randrange(1, 5)))
    for p, x in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(x)
    subprocess.run(["git", "init", "-q"], cwd=tmp_path, check=True)
    out = subprocess.run(["git", "-c", "core.excludesFile=/dev/null", "ls-files", "-o", "-z", "--exclude-standard"], cwd=tmp_path, check=True, capture_output=True).stdout.decode()
    rows = spark.createDataFrame(list(files.items()), "path string, content string")
    got = sorted(r["path"] for r in ignore.walk(rows.select("path"), ignore.rules_of(rows)).collect())
    want = sorted(x for x in out.split("\0") if x)
    assert got == want, {p: x for p, x in files.items() if p.endswith(".gitignore")}


def test_no_rules(spark):
    rows = spark.createDataFrame([("a/b.md", "x")], "path string, content string")
    assert ignore.walk(rows, ignore.rules_of(rows)).collect() == rows.collect()
