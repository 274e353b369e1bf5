"""Unified diffs as changed files with line ranges of the new side."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

HUNK = re.compile(r"^@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
GONE = "/dev/null"


def clean_path(name: str) -> str:
    """A name of a header line without timestamp, quotes and the a/ or b/ in front."""
    name = name.split("\t")[0].strip().strip('"')
    return name[2:] if len(name) > 2 and name[:2] in ("a/", "b/") else name


def touched(body: list[str], start: int) -> list[tuple[int, int]]:
    """Ranges of the new side that a hunk touches: each run of added lines, and the place of each
    run of removed lines that no added line follows directly."""
    runs: list[list] = []  # [sign, first line, line after]
    at = start
    for row in body:
        sign = row[:1] if row[:1] in ("+", "-", "\\") else " "
        if sign == "\\":
            continue
        if not runs or runs[-1][0] != sign:
            runs.append([sign, at, at])
        at += sign != "-"
        runs[-1][2] = at
    out = []
    for i, (sign, lo, hi) in enumerate(runs):
        if sign == "+":
            out.append((lo, hi - 1))
        elif sign == "-" and (i + 1 == len(runs) or runs[i + 1][0] != "+"):
            out.append((lo, lo))
    return out


def parse_unified(text: str | None) -> list[dict]:
    """Changed files of a unified diff, in its order; binary ones are left out. Null and empty: none.

    The counts of a hunk's header say where it ends, so a removed line `-- x` isn't read as a header."""
    files: list[dict] = []
    lines = (text or "").split("\n")
    i, cur = 0, None

    def fresh(old: str, new: str) -> dict:
        files.append({"old": old, "new": new, "binary": False, "ranges": [], "named": False})
        return files[-1]

    while i < len(lines):
        row = lines[i]
        hunk = HUNK.match(row)
        if row.startswith("diff --git "):
            names = row[len("diff --git ") :]
            half = names.find(" b/")
            cur = fresh(names[:half] if half > 0 else names, names[half + 1 :] if half > 0 else names)
        elif row.startswith("--- ") and i + 1 < len(lines) and lines[i + 1].startswith("+++ "):
            if cur is None or cur["named"]:
                cur = fresh("", "")
            cur.update(old=row[4:], new=lines[i + 1][4:], named=True)
            i += 1
        elif hunk and cur is not None:
            old_left, new_left = (int(x) if x is not None else 1 for x in (hunk[1], hunk[3]))
            body = []
            while i + 1 < len(lines) and (old_left > 0 or new_left > 0 or lines[i + 1].startswith("\\")):
                i += 1
                body.append(lines[i])
                sign = lines[i][:1]
                old_left -= sign not in ("+", "\\")
                new_left -= sign not in ("-", "\\")
            cur["ranges"] += touched(body, int(hunk[2]))
        elif cur is not None and not cur["named"]:
            if row.startswith("new file mode"):
                cur["old"] = GONE
            elif row.startswith("deleted file mode"):
                cur["new"] = GONE
            elif "binary" in row.lower():
                cur["binary"] = True
        i += 1
    out = []
    for f in files:
        if f["binary"]:
            continue
        old, new = clean_path(f["old"]), clean_path(f["new"])
        out.append({"path": old if new == GONE else new, "is_new": old == GONE, "is_deleted": new == GONE, "ranges": f["ranges"]})
    return out


def changed_files(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per changed file of each diff: key, ord, path, is_new, is_deleted, line_ranges. Narrow: no shuffle."""
    kind = diffs.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (k, n, f["path"], f["is_new"], f["is_deleted"], [{"start": a, "end": b} for a, b in f["ranges"]])
                for k, t in zip(batch["k"], batch["t"], strict=True)
                for n, f in enumerate(parse_unified(t))
            ]
            yield pd.DataFrame(rows, columns=["k", "ord", "path", "is_new", "is_deleted", "line_ranges"])

    schema = f"k {kind}, ord int, path string, is_new boolean, is_deleted boolean, line_ranges array<struct<start:bigint,end:bigint>>"
    return diffs.select(diffs[key].alias("k"), diffs[text].alias("t")).mapInPandas(parse, schema).withColumnRenamed("k", key)
