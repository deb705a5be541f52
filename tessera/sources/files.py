"""Source trees and Git as DataFrames."""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config
from tessera.functions.text import language

IGNORE_FILES = (".gitignore", ".noindex")
#: Subfolders beside the root in which a .noindex file counts.
NOINDEX_DIRS = ("src", "lib", "tests", "test", "docs", "doc", "examples", "example", "target", "build", "dist", "node_modules", ".git", "vendor")


class Ignore:
    """Patterns of ignore files: later ones win, `!` takes back, a slash inside ties a pattern to its folder, one at the end means folders."""

    def __init__(self, patterns: list[tuple[str, str]]):
        """patterns: (folder of the file, line)."""
        self.rules = []
        for base, line in patterns:
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            negated, line = line.startswith("!"), line.removeprefix("!")
            folder, body = line.endswith("/"), line.strip("/")
            tied = "/" in line.rstrip("/")
            parts = "/".join({"**": ".*"}.get(p) or fnmatch.translate(p)[4:-3].replace(".*", "[^/]*") for p in body.split("/"))
            parts = parts.replace(".*/", "(?:.*/)?")
            prefix = re.escape(base + "/") if base else ""
            self.rules.append((re.compile(f"^{prefix}{'' if tied else '(?:.*/)?'}{parts}{'/' if folder else '(?:/|$)'}"), negated))

    def __call__(self, path: str, folder: bool = False) -> bool:
        out = False
        for rule, negated in self.rules:
            if rule.match(path + "/" * folder):
                out = not negated
        return out


def ignore_of(root: str, files: tuple[str, ...] = IGNORE_FILES) -> Ignore:
    """Patterns of the root's ignore files and of its local exclude file."""
    found = []
    for name in (*files, ".git/info/exclude"):
        if os.path.isfile(f"{root}/{name}"):
            with open(f"{root}/{name}", errors="replace") as f:
                found += [("", line) for line in f]
    return Ignore(found)


def has_noindex(root: str) -> bool:
    return any(os.path.isfile(os.path.join(root, d, ".noindex")) for d in ("", *NOINDEX_DIRS))


def watch_ignored(path: str, ignore: Ignore) -> bool:
    """For change events: anything inside .git, then the patterns."""
    return ".git" in path.split("/") or ignore(path)


def walk(root: str, hidden: bool = True) -> Iterator[str]:
    """Relative paths in order: ignore files of every folder count, .git and links are skipped."""
    def scan(folder: str, rules: list[tuple[str, str]]) -> Iterator[str]:
        full = os.path.join(root, folder) if folder else root
        for name in (*IGNORE_FILES, *([".git/info/exclude"] if not folder else [])):
            if os.path.isfile(os.path.join(full, name)):
                with open(os.path.join(full, name), errors="replace") as f:
                    rules = rules + [(folder, line) for line in f]
        ignore = Ignore(rules)
        for entry in sorted(os.scandir(full), key=lambda e: e.name):
            path = f"{folder}/{entry.name}" if folder else entry.name
            if entry.name == ".git" or entry.is_symlink() or not hidden and entry.name.startswith(".") or ignore(path, entry.is_dir()):
                continue
            if entry.is_dir():
                yield from scan(path, rules)
            else:
                yield path

    yield from scan("", [])


def source_files(spark: SparkSession, root: str, overrides: dict[str, str] | None = None, hidden: bool = True) -> DataFrame:
    """path, content, size, mtime, language of text files up to MAX_FILE_BYTES; the driver lists names, Spark reads contents."""
    names = spark.createDataFrame([(p,) for p in walk(root, hidden)], "path string")
    base = os.path.abspath(root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).where(F.col("length") <= config.MAX_FILE_BYTES)
    rows = raw.select(F.expr(f"substring(path, instr(path, '{base}/') + {len(base) + 1})").alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))
    return rows.join(F.broadcast(names), "path").withColumn("language", language(F.col("path"), overrides))  # names were listed by the driver


def repo_stamp(files: DataFrame) -> tuple:
    """Files, bytes and newest change: a result computed for one stamp holds while it stays."""
    return tuple(files.agg(F.count("*"), F.sum("size"), F.max("mtime")).first())


def fingerprint(files: DataFrame) -> int:
    """Order-free hash of (path, size, mtime)."""
    return files.agg(F.sum(F.xxhash64("path", "size", "mtime").cast("decimal(38,0)"))).first()[0] or 0


def git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True, errors="replace").stdout


def commits(spark: SparkSession, root: str, branch: str = "HEAD", since: str | None = None) -> DataFrame:
    """hash, author, date (Unix seconds), message, files; oldest first, from behind `since`."""
    log = git(root, "log", "--reverse", "--format=%H|%an|%at|%B%x00", f"{since}..{branch}" if since else branch)
    rows = []
    for record in filter(None, (x.strip("\n") for x in log.split("\0"))):
        h, author, date, message = record.split("|", 3)
        rows.append((h, author, int(date), message.strip(), commit_files(root, h)))
    return spark.createDataFrame(rows, "hash string, author string, date bigint, message string, files array<string>")


def commit_files(root: str, commit: str) -> list[str]:
    return sorted(filter(None, git(root, "diff-tree", "--root", "--no-commit-id", "--name-only", "-r", commit).split("\n")))


def commit_diff(root: str, commit: str, limit: int = 8000) -> str:
    return git(root, "show", "--format=", commit)[:limit]


def changed_since(root: str, commit: str) -> list[str]:
    return sorted(filter(None, git(root, "diff", "--name-only", f"{commit}..HEAD").split("\n")))


def staged(root: str) -> list[str]:
    return sorted(filter(None, git(root, "diff", "--cached", "--name-only").split("\n")))


def all_changed(root: str) -> list[str]:
    """Staged, unstaged and untracked."""
    more = git(root, "diff", "--name-only") + git(root, "ls-files", "--others", "--exclude-standard")
    return sorted({*staged(root), *filter(None, more.split("\n"))})


def resolve_ref(root: str, ref: str) -> str | None:
    try:
        return git(root, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}").strip() or None
    except subprocess.CalledProcessError:
        return None


def merge_base(root: str, a: str, b: str) -> str:
    return git(root, "merge-base", a, b).strip()


def commits_ahead(root: str, base: str, ref: str = "HEAD") -> int:
    return int(git(root, "rev-list", "--count", f"{base}..{ref}"))


def default_branch(root: str) -> str | None:
    return next((b for b in ("main", "master", "develop") if resolve_ref(root, b)), None)
