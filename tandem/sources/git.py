"""Git access (SRC1, SRC2, SRC9-SRC11): driver-side utilities, and a Python data source for commit logs.

None of this is on a query's path: repositories are exported once, and queries read tables.
"""

from __future__ import annotations

import re
import shutil
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.state import ship

CLONE_SECONDS, SHOW_SECONDS, PARSE_SECONDS = 300, 10, 5


def repository_name(url: str) -> str:
    name = re.split(r"[/:]", url.rstrip("/").removesuffix(".git"))[-1]
    return name or "cloned_repo"


def _git(args: list[str], cwd: str | Path | None = None, seconds: float = SHOW_SECONDS) -> str | None:
    try:
        done = subprocess.run(["git", *args], cwd=cwd, capture_output=True, timeout=seconds)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.decode("utf-8", "ignore") if done.returncode == 0 else None


def clone(url: str, folder: str | Path, name: str | None = None, branch: str | None = None) -> bool:
    """SRC1: an existing clone is kept; a folder that is none is replaced."""
    target = Path(folder) / (name or repository_name(url))
    if (target / ".git").exists():
        return True
    if target.exists():
        shutil.rmtree(target)
    return _git(["clone", *(["--branch", branch] if branch else []), url, str(target)], seconds=CLONE_SECONDS) is not None


def find_root(path: str | Path) -> Path | None:
    """SRC11: the nearest folder upwards that has a .git folder."""
    here = Path(path).resolve()
    return next((p for p in (here, *here.parents) if (p / ".git").is_dir()), None)


def file_at(repo: str | Path, commit: str, path: str) -> str | None:
    """SRC9."""
    return _git(["show", f"{commit}:" + path.replace("\\", "/")], repo)


def file_before(repo: str | Path, commit: str, path: str) -> str | None:
    """SRC10: at the parent; None at a root commit."""
    parent = _git(["rev-parse", "--verify", "-q", f"{commit}^"], repo, PARSE_SECONDS)
    return file_at(repo, parent.strip(), path) if parent else None


def blobs(details: DataFrame, repo: str) -> DataFrame:
    """SRC9, SRC10: (commit, path, code): each file before its commit, else at it. ``repo`` is a path that each machine has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            code = [file_before(repo, c, p) or file_at(repo, c, p) for c, p in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string())], names=["commit", "path", "code"])

    ship(details.sparkSession)
    return details.select("commit", F.col("path")).distinct().mapInArrow(run, "commit string, path string, code string").where("code is not null")


class GitLog(DataSource):
    """SRC2: ``spark.read.format("git_log").load(repo)``; option ``max_commits`` (0: all). One partition a chunk of commits."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "hash string, author_name string, author_email string, committer_date string, message string, seq long, path string, old_path string, diff string"

    def reader(self, schema) -> DataSourceReader:
        return GitLogReader(self.options)


class Chunk(InputPartition):
    def __init__(self, start: int, hashes: list[str]) -> None:
        super().__init__(start)
        self.start, self.hashes = start, hashes


class GitLogReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.repo = options.get("path")
        self.limit = int(options.get("max_commits", 0))
        self.size = int(options.get("chunk", 200))

    def partitions(self) -> list[Chunk]:
        listed = (_git(["rev-list", "--reverse", "HEAD"], self.repo, CLONE_SECONDS) or "").split()
        listed = listed[: self.limit] if self.limit else listed
        return [Chunk(i, listed[i : i + self.size]) for i in range(0, len(listed), self.size)] or [Chunk(0, [])]

    def read(self, part: Chunk):
        for k, commit in enumerate(part.hashes):
            head = _git(["show", "-s", "--format=%an%x00%ae%x00%cI%x00%B", commit], self.repo) or "\0\0\0"
            name, email, date, message = head.rstrip("\n").split("\0", 3)
            text = _git(["show", "--format=", "--no-color", "-M", "-U3", commit], self.repo, CLONE_SECONDS) or ""
            for piece in re.split(r"(?m)^diff --git ", text)[1:]:
                old, new = (re.search(p, piece, re.M) for p in (r"^--- (?:a/)?(.*)$", r"^\+\+\+ (?:b/)?(.*)$"))
                named = [None if m is None or m[1] == "/dev/null" else m[1] for m in (old, new)]
                at = piece.find("\n@@")
                yield commit, name, email, date, message, part.start + k, named[1], named[0], piece[at + 1 :] if at >= 0 else ""
