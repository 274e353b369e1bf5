"""Small texts for people: times, shares, plurals, shortened paths; and lists that people type."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short names of languages; folders that a package name begins at.
LANGUAGES = {"js": "javascript", "javascript": "javascript", "ts": "typescript", "typescript": "typescript", "py": "python", "python": "python", "go": "go", "golang": "go"}
PACKAGE_ROOTS = ["internal", "cmd", "pkg", "src", "app", "lib"]
MINUTE, HOUR, DAY = 60, 3600, 86400


def plural(n: int, word: str, many: str | None = None) -> str:
    return f"{n} {word if n == 1 else many or word + 's'}"


def percent(part: float, whole: float) -> float:
    """0 of nothing."""
    return 100.0 * part / whole if whole else 0.0


def relative_time(then: Column, now: Column) -> Column:
    """Seconds since the epoch as 'n units ago'; null or 0 is unknown."""
    d = now - then
    steps = ((HOUR, MINUTE, "minute"), (DAY, HOUR, "hour"), (30 * DAY, DAY, "day"), (365 * DAY, 30 * DAY, "month"), (None, 365 * DAY, "year"))
    out = F.when(then.isNull() | (then == 0), "unknown").when(d < MINUTE, "just now")
    for below, unit, word in steps:
        n = F.floor(d / unit)
        text = F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
        out = out.otherwise(text) if below is None else out.when(d < below, text)
    return out


def truncate(text: str, most: int) -> str:
    """At most so many characters; three dots stand for what is cut, where they fit."""
    return text if len(text) <= most else text[:most] if most <= 3 else text[: most - 3] + "..."


def short_path(path: str, base: str) -> str:
    """path as seen from base."""
    if not base or posixpath.isabs(path) != posixpath.isabs(base):
        return path
    return posixpath.relpath(path, base)


def tail_path(path: str, segments: int = 2) -> str:
    """The last segments, after dots if there are more."""
    parts = path.replace("\\", "/").split("/")
    return path if len(parts) <= segments else ".../" + "/".join(parts[-segments:])


def owner_repo(remote: str) -> str:
    """owner/repo of a remote that is written host/owner/repo."""
    return "/".join(remote.removesuffix(".git").rstrip("/").split("/")[-2:])


def package_path(path: Column) -> Column:
    """Two folders from the first one that packages begin at; else the folder; 'root' without one."""
    folders = F.slice(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    places = F.array_compact(F.array(*(F.nullif(F.array_position(folders, F.lit(r)), F.lit(0).cast("long")) for r in PACKAGE_ROOTS)))
    at = F.array_min(places)
    return F.when(at.isNotNull(), F.array_join(F.slice(folders, at.cast("int"), 2), "/")).when(F.size(folders) > 0, F.array_join(folders, "/")).otherwise("root")


def globs(text: str) -> list[str]:
    """Comma-separated globs without blanks."""
    return [g.strip() for g in text.split(",") if g.strip()]


def language(name: str) -> str:
    key = name.strip().lower()
    return LANGUAGES.get(key, key)


def languages(text: str) -> list[str] | None:
    """Comma-separated languages by their full names; None, which is all of them, for an empty text."""
    return sorted({language(x) for x in text.split(",") if x.strip()}) if text else None


def import_name(path: Column, lang: Column) -> Column:
    """What an import's path is called in the file: the last segment, without the endings of scripts and the dots of Python."""
    last = F.element_at(F.split(path, "/"), -1)
    script = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(last, r"\.ts$", ""), r"\.tsx$", ""), r"\.js$", ""), r"\.jsx$", "")
    python = F.element_at(F.split(F.ltrim(path, F.lit(".")), r"\."), -1)
    return F.when(lang == "go", last).when(lang.isin("javascript", "typescript"), script).when(lang == "python", python).otherwise("")
