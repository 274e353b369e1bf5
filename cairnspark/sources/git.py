"""What git says of a repository, read on the driver. The process that runs it can be given (tests, other tools)."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from cairnspark.sources.history import FIELD, RECORD

Run = Callable[[list[str]], bytes]


def runner(repo: str, timeout: float | None = None) -> Run:
    """git in repo. An exit of 1 with output is an answer (git diff), any other failure an error."""

    def run(args: list[str]) -> bytes:
        done = subprocess.run(["git", "-C", repo, *args], capture_output=True, timeout=timeout, check=False)
        if done.returncode and not (done.returncode == 1 and done.stdout):
            raise RuntimeError(f"git {args[0]}: {done.stderr.decode('utf-8', 'replace').strip()}")
        return done.stdout

    return run


def _line(run: Run, args: list[str]) -> str:
    try:
        return run(args).decode("utf-8", "replace").strip()
    except (RuntimeError, OSError):
        return ""


def root(run: Run) -> str:
    """Empty outside of a repository."""
    return _line(run, ["rev-parse", "--show-toplevel"])


def head(run: Run) -> str:
    return _line(run, ["rev-parse", "HEAD"])


def remote(run: Run) -> str:
    return _line(run, ["config", "--get", "remote.origin.url"])


def working_diff(run: Run) -> str:
    """What the working tree changes against HEAD; no revision can be passed in."""
    return run(["diff", "HEAD"]).decode("utf-8", "replace")


def _table(spark: SparkSession, rows: Iterator[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def log(spark: SparkSession, run: Run, most: int) -> DataFrame:
    """The last commits along first parents, newest first, as records that history.commits reads: place, value."""
    text = run(["log", "--first-parent", f"-{most}", f"--format=%H{FIELD}%P{FIELD}%ct{FIELD}%s{RECORD}"]).decode("utf-8", "replace")
    return _table(spark, ((i, r.lstrip("\n")) for i, r in enumerate(text.split(RECORD)) if r.strip()), "place long, value string")


def bodies(spark: SparkSession, run: Run, most: int) -> DataFrame:
    """Bodies of the last commits of the whole log: body."""
    text = run(["log", f"-{most}", f"--format=%B{RECORD}"]).decode("utf-8", "replace")
    return _table(spark, ((b,) for b in text.split(RECORD) if b.strip()), "body string")


def numstat(spark: SparkSession, run: Run, shas: list[str]) -> DataFrame:
    """sha, value: the lines that each commit adds and deletes by file, against its first parent."""
    return _table(spark, ((s, run(["diff", "--numstat", f"{s}^1", s]).decode("utf-8", "replace")) for s in shas), "sha string, value string")


def commit_diffs(spark: SparkSession, run: Run, shas: list[str]) -> DataFrame:
    """sha, diff: each commit against its first parent."""
    return _table(spark, ((s, run(["diff", f"{s}^1", s]).decode("utf-8", "replace")) for s in shas), "sha string, diff string")


def snapshot(run: Run, sha: str) -> Iterator[tuple[str, bytes]]:
    """Path and bytes of every file of the tree at a commit, from an archive: no worktree is checked out. Links are left out."""
    import io
    import tarfile

    with tarfile.open(fileobj=io.BytesIO(run(["archive", "--format=tar", sha]))) as tar:
        for member in tar:
            if member.isfile():
                yield member.name, tar.extractfile(member).read()


def author_log(spark: SparkSession, run: Run, paths: list[str] = ()) -> DataFrame:
    """Authors by commit and file, newest first, from one log over all paths: author, email, unix_time, path."""
    text = run(["log", f"--format={RECORD}%an{FIELD}%ae{FIELD}%ct", "--name-only", "--", *paths]).decode("utf-8", "replace")
    rows = []
    for record in text.split(RECORD)[1:]:
        head_, *names = record.split("\n")
        author, email, when = (head_.split(FIELD) + ["", "", ""])[:3]
        rows += [(author, email, int(when) if when.isdigit() else 0, n) for n in names if n]
    return _table(spark, iter(rows), "author string, email string, unix_time long, path string")
