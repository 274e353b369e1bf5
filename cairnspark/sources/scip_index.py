"""Where SCIP indexes come from: one that is there, one that is still fresh, or one that an indexer makes.

Runs on the driver beside the sources. How a program is looked up and run can be given."""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

# The public indexers, the languages they read, the files that mark a project of theirs, and what they are called with.
INDEXERS = {
    "scip-go": (["go"], ["go.mod"], []),
    "scip-typescript": (["typescript", "javascript"], ["package.json"], ["index"]),
    "scip-python": (["python"], ["pyproject.toml", "requirements.txt"], ["index", ".", "--project-name"]),
}


@dataclass
class Status:
    name: str
    state: str  # used_existing, skipped, cached, missing_binary, failed, generated
    output: str = ""
    reason: str = ""
    generated: bool = False


@dataclass
class Candidate:
    name: str
    folder: str
    prefix: str
    output: str
    args: list[str]
    markers: list[str]
    sources: list[str] = field(default_factory=list)


@dataclass
class Hooks:
    which: Callable[[str], str | None] = shutil.which
    run: Callable[[list[str], str], None] = lambda args, folder: subprocess.run(args, cwd=folder, check=True, capture_output=True)


def nearest(root: str, path: str, marker: str) -> str:
    """The nearest folder above path, root at most, that holds the marker; empty without one."""
    root, folder = os.path.normpath(root), os.path.dirname(os.path.normpath(path))
    while True:
        if os.path.exists(os.path.join(folder, marker)):
            return folder
        if folder == root or folder == os.path.dirname(folder):
            return ""
        folder = os.path.dirname(folder)


def candidates(root: str, files: dict[str, list[str]]) -> list[Candidate]:
    """files: paths by language. One candidate an indexer at the root; scripts one for each project folder that has any."""
    out = []
    for name, (languages, markers, args) in INDEXERS.items():
        own = [p for x in languages for p in files.get(x, [])]
        args = [*args, os.path.basename(os.path.normpath(root))] if name == "scip-python" else args
        projects: dict[str, list[str]] = {}
        if name == "scip-typescript":
            for p in own:
                if at := nearest(root, p, markers[0]):
                    projects.setdefault(at, []).append(p)
        if not projects:
            out.append(Candidate(name, root, "", f"{name}.scip", args, markers, own))
        for at in sorted(projects):
            rel = os.path.relpath(at, root).replace(os.sep, "/")
            prefix = "" if rel == "." else rel
            label = f"{name}@{prefix}" if prefix else name
            out.append(Candidate(label, at, prefix, f"{label.replace('@', '-').replace('/', '-')}.scip", args, markers, projects[at]))
    return out


def _mtime(path: str) -> float | None:
    try:
        return os.stat(path).st_mtime
    except OSError:
        return None


def fresh(index: str, folder: str, sources: list[str], markers: list[str]) -> bool:
    """Whether an index is as new as every source and every marker that there is."""
    made = _mtime(index)
    if made is None:
        return False
    times = [_mtime(p) for p in sources]
    return all(t is not None and t <= made for t in times) and all((t := _mtime(os.path.join(folder, m))) is None or t <= made for m in markers)


def collect(root: str, out: str, files: dict[str, list[str]], hooks: Hooks | None = None) -> tuple[list[tuple[str, str]], list[Status]]:
    """(index, prefix of its paths) of every index to read, and what became of each candidate."""
    hooks, there = hooks or Hooks(), os.path.join(root, "index.scip")
    if os.path.exists(there):
        return [(there, "")], [Status("index.scip", "used_existing", there)]
    found, states = [], []
    for c in candidates(root, files):
        target, command = os.path.join(out, "scip", c.output), c.name.split("@")[0]
        if not c.sources:
            states.append(Status(c.name, "skipped", reason="no matching source files"))
        elif not any(os.path.exists(os.path.join(c.folder, m)) for m in c.markers):
            states.append(Status(c.name, "skipped", reason=f"no project marker ({', '.join(c.markers)})"))
        elif fresh(target, c.folder, c.sources, c.markers):
            found.append((target, c.prefix))
            states.append(Status(c.name, "cached", target))
        elif not hooks.which(command):
            states.append(Status(c.name, "missing_binary", reason=f"{command} is not installed"))
        else:
            made, error = os.path.join(c.folder, "index.scip"), ""
            os.makedirs(os.path.dirname(target), exist_ok=True)
            try:
                hooks.run([command, *c.args], c.folder)
            except (OSError, subprocess.SubprocessError) as e:
                error = str(e)
            if not error and not os.path.exists(made):
                error = "the indexer ended without an index"
            if error:
                states.append(Status(c.name, "failed", reason=error))
                continue
            os.replace(made, target)
            found.append((target, c.prefix))
            states.append(Status(c.name, "generated", target, generated=True))
    return found, states


def status_table(spark: SparkSession, states: list[Status]) -> DataFrame:
    return spark.createDataFrame([asdict(s) for s in states], "name string, state string, output string, reason string, generated boolean")
