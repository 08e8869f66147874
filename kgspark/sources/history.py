"""A Spark data source over ``git log``; tables of the same shape can be used instead."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_COMMITS = "sha string, subject string, author_name string, author_email string, authored_at string, committer_name string, committer_email string, committed_at string, parent_shas array<string>, is_merge boolean"
_FILES = "sha string, path string, lines_changed long"
_TAGS = "name string, tag_type string, target_sha string, tagger_name string, tagger_email string, tagged_at string"
_BRANCHES = "name string, head_sha string"
_CHANGES = "commit_sha string, change string, path string, blob_sha string"
_SIMILAR = "commit_sha string, old_path string, new_path string, score long"
SCHEMAS = {"commits": _COMMITS, "commit_files": _FILES, "tags": _TAGS, "branches": _BRANCHES, "changes": _CHANGES, "similar": _SIMILAR}
#: Least similarity, in percent, of the pairs in ``similar``.
SIMILAR = 70


def _git(repo: str, *args: str, end: str = "\n") -> Iterator[str]:
    """The output of git, record by record, never held whole."""
    with subprocess.Popen(["git", "-C", repo, "-c", "core.quotePath=false", *args], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run:
        rest = b""
        while block := run.stdout.read(1 << 16):
            *records, rest = (rest + block).split(end.encode())
            for record in records:
                yield record.decode("utf-8", "replace")
        if rest:
            yield rest.decode("utf-8", "replace")
    if run.returncode:
        raise RuntimeError(f"git {args[0]} failed in {repo}")


def _iso(stamp: str) -> str:
    from datetime import UTC, datetime

    return datetime.fromtimestamp(int(stamp), UTC).strftime("%Y-%m-%dT%H:%M:%SZ") if stamp else ""


def read(repo: str, table: str) -> Iterator[tuple]:
    """The rows of one table of a repository."""
    if table == "commits":
        for record in _git(repo, "log", "--all", "--format=%H%x1f%s%x1f%an%x1f%ae%x1f%at%x1f%cn%x1f%ce%x1f%ct%x1f%P%x1e", end="\x1e"):
            if record.strip():
                sha, subject, an, ae, at, cn, ce, ct, parents = record.strip("\n").split("\x1f")
                own = parents.split()
                yield sha, subject, an, ae, _iso(at), cn, ce, _iso(ct), own, len(own) > 1
    elif table == "commit_files":
        sha = ""
        for line in _git(repo, "log", "--all", "--numstat", "--no-renames", "--format=%x1e%H"):
            if line.startswith("\x1e"):
                sha = line[1:]
            elif line.strip():
                added, removed, path = line.split("\t", 2)
                yield sha, path, abs(int(added) - int(removed)) if added != "-" else 0
    elif table == "tags":
        for line in _git(repo, "for-each-ref", "refs/tags", "--format=%(refname:short)%1f%(objecttype)%1f%(objectname)%1f%(*objectname)%1f%(taggername)%1f%(taggeremail:trim)%1f%(taggerdate:unix)"):
            name, kind, own, target, tagger, email, date = line.split("\x1f")
            yield name, "annotated" if kind == "tag" else "lightweight", target or own, tagger or None, email or None, _iso(date) or None
    elif table == "branches":
        for line in _git(repo, "for-each-ref", "refs/heads", "--format=%(refname:short)%1f%(objectname)"):
            yield tuple(line.split("\x1f"))
    elif table == "changes":
        sha = ""
        for line in _git(repo, "log", "--all", "--raw", "--no-abbrev", "--no-renames", "--diff-filter=AD", "--format=%x1e%H"):
            if line.startswith("\x1e"):
                sha = line[1:]
            elif line.startswith(":"):
                head, path = line[1:].split("\t", 1)
                _, _, old, new, kind = head.split()
                yield sha, "add" if kind == "A" else "delete", path, new if kind == "A" else old
    elif table == "similar":
        sha = ""
        for line in _git(repo, "log", "--all", "--raw", "--no-abbrev", f"--find-renames={SIMILAR}%", "-l0", "--diff-filter=R", "--format=%x1e%H"):
            if line.startswith("\x1e"):
                sha = line[1:]
            elif line.startswith(":"):
                head, old, new = line[1:].split("\t")
                yield sha, old, new, int(head.split()[4][1:])


class _Reader(DataSourceReader):
    def __init__(self, repo: str, table: str):
        self.repo, self.table = repo, table

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        return read(self.repo, self.table)


class GitHistory(DataSource):
    """``spark.read.format("git_history").option("repo", path).option("table", "commits").load()``."""

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema):
        return _Reader(self.options["repo"], self.options.get("table", "commits"))
