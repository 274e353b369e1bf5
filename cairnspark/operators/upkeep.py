"""Upkeep of resolved calls as files change.

Kept beside the calls are the keys that functions are found by, and, turned around, the keys that are asked for: what calls of
a file ask alike is one answer (see build.ASK), however many they are. A change touches keys: those that gained or lost a
definition. An answer is worked out anew if it asked for such a key, if its file changed, or if what its imports or receivers
mean did; all others stay. Imports and the types of receivers are worked out over all files each time: they are few beside
the calls, and any file may decide them.

The tables are staged, so each state stands by itself; sites are the calls joined with their answers as they are read. drop()
removes a state that no newer one reads (none does).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.operators import build, types
from cairnspark.staging import drop_staged, staged

UNBOUND = "file_path string, alias string, b struct<path:string,symbol:string,target:string>, target_package string"


@dataclass
class Rows:
    """Parsed files with what they hold as rows."""

    files: DataFrame  # file_path and, where files have them, the columns that imports and types are read from
    functions: DataFrame  # build.functions
    calls: DataFrame  # build.calls


@dataclass
class State:
    files: DataFrame  # parsed
    calls: DataFrame  # build.calls
    bound: DataFrame  # build.bindings
    known: DataFrame | None  # types.receivers
    defined: DataFrame  # build.definitions
    asked: DataFrame  # build.tries_of what calls ask for
    answers: DataFrame  # build.resolved
    changed: DataFrame  # the answers that the last change worked out

    @property
    def sites(self) -> DataFrame:
        """Every call with its answer."""
        return _sites(self.calls, self.answers)

    @property
    def again(self) -> DataFrame:
        """The calls whose answer the last change worked out."""
        return _sites(self.calls, self.changed)

    def drop(self) -> None:
        every = (self.files, self.calls, self.bound, self.known, self.defined, self.asked, self.answers, self.changed)
        drop_staged(*{id(x): x for x in every if x is not None}.values())


def _sites(calls: DataFrame, answers: DataFrame) -> DataFrame:
    return build.answered(calls, answers).select(*(c for c in build.SITE if c in calls.columns), "status", "target")


def rows_of(files: DataFrame) -> Rows:
    return Rows(files, build.functions(files), build.calls(files))


def _read(files: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    found = build.bindings(files, build.imports(files)) if "imports" in files.columns else files.sparkSession.createDataFrame([], UNBOUND)
    bound = staged(found, "bound")
    return bound, staged(types.receivers(files, bound), "known") if "facts" in files.columns else None


def _asked(calls: DataFrame, bound: DataFrame, known: DataFrame | None) -> DataFrame:
    ask = build.ask_of(calls)
    return build.tries_of(calls.select(*ask).distinct(), bound, known, ask)


def start(files: DataFrame) -> State:
    """Every call of parsed files resolved."""
    return start_rows(rows_of(staged(files, "files")))


def start_rows(rows: Rows) -> State:
    """start, on rows; their files need not be staged."""
    files = rows.files if hasattr(rows.files, "_cairn_path") else staged(rows.files, "files")
    bound, known = _read(files)
    calls, defined = staged(rows.calls, "calls"), staged(build.definitions_of(rows.functions), "defined")
    asked = staged(_asked(calls, bound, known), "asked")
    answers = staged(build.resolved(asked, build.targets(defined), build.ask_of(calls)), "answers")
    return State(files, calls, bound, known, defined, asked, answers, answers)


def _changed(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """The values of a column in rows that only one side has, or has more often."""
    sides = old.withColumn("side", F.lit(-1)).unionByName(new.withColumn("side", F.lit(1)))
    return sides.groupBy(*old.columns).agg(F.sum("side").alias("more")).filter("more != 0").select(column).distinct()


def change(old: State, fresh: DataFrame, gone: DataFrame | None = None) -> State:
    """fresh: files parsed anew, changed or added; gone: file_path of deleted ones (a path in both is fresh). The state that start gives on
    the files as they are now. Changes to nothing resolve nothing."""
    fresh = staged(fresh.select(*old.files.columns), "fresh")
    state = change_rows(old, rows_of(fresh), gone)
    drop_staged(fresh)
    return state


def change_rows(old: State, fresh: Rows, gone: DataFrame | None = None) -> State:
    """change, on rows."""
    paths = fresh.files.select("file_path")
    paths = staged((paths if gone is None else paths.unionByName(gone.select("file_path"))).distinct(), "paths")
    now_with = lambda had, new: had.join(paths, "file_path", "left_anti").select(*had.columns).unionByName(new.select(*had.columns))
    files, calls = staged(now_with(old.files, fresh.files), "files"), staged(now_with(old.calls, fresh.calls), "calls")
    bound, known = _read(files)
    dirty = paths.unionByName(_changed(old.bound, bound, "file_path"))
    if known is not None:
        dirty = dirty.unionByName(_changed(old.known, known, "file_path"))
    dirty = staged(dirty.distinct(), "dirty")

    now = staged(build.definitions_of(fresh.functions), "now")
    touched = staged(_changed(old.defined.join(paths, "file_path", "left_semi").select(*now.columns), now, "key"), "touched")
    defined = staged(now_with(old.defined, now), "defined")

    ask = build.ask_of(calls)
    anew = staged(_asked(calls.join(dirty, "file_path", "left_semi").select(*calls.columns), bound, known), "anew")
    kept = old.asked.join(dirty, "file_path", "left_anti").select(*anew.columns)
    asked = staged(kept.unionByName(anew), "asked")
    by_key = staged(kept.join(touched, "key", "left_semi").select(*ask).distinct(), "by_key")
    due = staged(anew.unionByName(build.alike(kept, by_key, ask, "left_semi")), "due")
    known_keys = build.targets(defined.join(due.select("key").distinct(), "key", "left_semi"))
    again = staged(build.resolved(due, known_keys, ask), "again")
    rest = build.alike(old.answers.join(dirty, "file_path", "left_anti"), by_key, ask, "left_anti").select(*again.columns)
    answers = staged(rest.unionByName(again), "answers")
    drop_staged(paths, dirty, now, touched, anew, by_key, due)
    return State(files, calls, bound, known, defined, asked, answers, again)
