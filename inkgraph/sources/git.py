"""Snapshots of a git repository as a Spark data source.

``spark.read.format("git_snapshot").option("repo", path).option("snapshot", "head")``
gives (path, content, mtime_ns, size_bytes); snapshot is worktree, index or head.
Paths are listed once on the driver and read in parallel; every executor must
reach the repository.  A symbolic link is followed within the snapshot, at most
eight times; one that leads out of it has no content.
"""

from __future__ import annotations

import os
import posixpath
import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LINK_HOPS = 8
LINK_MODE = "120000"


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout


def revision(repo: str) -> str:
    """The commit that HEAD stands for; empty without one."""
    try:
        return _git(repo, "rev-parse", "--verify", "-q", "HEAD").decode().strip()
    except subprocess.CalledProcessError:
        return ""


def _entries(repo: str, snapshot: str) -> list[tuple[str, str, str]]:
    """(path, mode, object) of a snapshot; files of the work tree have no object."""
    split = lambda raw: [x for x in raw.decode().split("\0") if x]
    if snapshot == "worktree":
        names = sorted(set(split(_git(repo, "ls-files", "-z", "--cached", "--others", "--exclude-standard"))))
        return [(n, LINK_MODE if os.path.islink(os.path.join(repo, n)) else "100644", "") for n in names]
    if snapshot == "index":
        rows = [x.split("\t", 1) for x in split(_git(repo, "ls-files", "-s", "-z"))]
        return sorted((name, *head.split(" ")[:2]) for head, name in rows if not head.startswith("160000"))
    if snapshot == "head":
        rows = [x.split("\t", 1) for x in split(_git(repo, "ls-tree", "-r", "-z", "HEAD"))]
        return sorted((name, head.split(" ")[0], head.split(" ")[2]) for head, name in rows if head.split(" ")[1] == "blob")
    raise ValueError(f"unknown snapshot: {snapshot}")


class _Part(InputPartition):
    def __init__(self, rows: list):
        super().__init__(0)
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.snapshot = options["repo"], options.get("snapshot", "worktree")
        self.parts = int(options.get("partitions", "8"))

    def partitions(self) -> list[_Part]:
        rows = _entries(self.repo, self.snapshot)
        links = {n: (m, o) for n, m, o in rows}
        resolved = [(n, self._follow(n, links)) for n, _, _ in rows]
        return [_Part(resolved[i :: self.parts]) for i in range(min(self.parts, max(len(resolved), 1)))]

    def _follow(self, name: str, entries: dict) -> tuple[str, str] | None:
        for _ in range(LINK_HOPS):
            mode, blob = entries.get(name, ("", ""))
            if not mode:
                return None
            if mode != LINK_MODE:
                return name, blob
            target = os.readlink(os.path.join(self.repo, name)) if self.snapshot == "worktree" else _git(self.repo, "cat-file", "blob", blob).decode()
            name = posixpath.normpath(posixpath.join(posixpath.dirname(name), target))
            if target.startswith("/") or name.startswith(".."):
                return None
        return None

    def read(self, partition: _Part) -> Iterator[tuple]:
        for name, source in partition.rows:
            data, mtime = None, 0
            if source and source[1]:
                data = _git(self.repo, "cat-file", "blob", source[1])
            elif source:
                try:
                    with open(os.path.join(self.repo, source[0]), "rb") as f:
                        data = f.read()
                    mtime = os.stat(os.path.join(self.repo, source[0])).st_mtime_ns
                except OSError:
                    data = None
            try:
                text = None if data is None else data.decode()
            except UnicodeDecodeError:
                text = None
            yield name, text, mtime, 0 if data is None else len(data)


class GitSnapshot(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_snapshot"

    def schema(self) -> str:
        return "path string, content string, mtime_ns long, size_bytes long"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitSnapshot)


def renames(repo: str, staged: bool = False) -> list[tuple[str, str]]:
    """(old, new) of the renames that git sees between HEAD and the work tree, or the index."""
    raw = _git(repo, "diff", *(["--cached"] if staged else []), "--diff-filter=R", "-M", "--name-status", "-z", "HEAD").decode().split("\0")
    return [(raw[i + 1], raw[i + 2]) for i in range(0, len(raw) - 2, 3)]


def history(repo: str, path: str, most: int = 100) -> list[tuple[str, int, str]]:
    """(path, ord, content) of the newest versions of a file, through renames."""
    out = []
    log = _git(repo, "log", "--follow", f"-n{most}", "--format=%x01%H", "--name-only", "--", path).decode()
    for entry in log.split("\x01")[1:]:
        commit, _, name = entry.strip().partition("\n")
        try:
            out.append((path, len(out), _git(repo, "show", f"{commit}:{name.strip()}").decode()))
        except (subprocess.CalledProcessError, UnicodeDecodeError):
            continue
    return out
