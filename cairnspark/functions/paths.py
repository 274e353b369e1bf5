"""Column and driver functions for paths, globs, ids and remotes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(path: Column) -> Column:
    """Slashes forward, no '.', '//' or resolvable '..': a fold over the segments."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    rooted = p.startswith("/")

    def step(acc, seg):
        last = F.element_at(acc, -1)
        up = (seg == "..") & (F.size(acc) > 0) & F.coalesce(last != "..", F.lit(False))
        return (
            F.when((seg == "") | (seg == "."), acc)
            .when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when((seg == "..") & rooted, acc)
            .otherwise(F.concat(acc, F.array(seg)))
        )

    body = F.array_join(F.aggregate(F.split(p, "/"), F.expr("cast(array() as array<string>)"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), body)).when(body == "", ".").otherwise(body)


def has_suffix(path: Column, suffix: Column) -> Column:
    """suffix ends path at a segment border."""
    return (path == suffix) | path.endswith(F.concat(F.lit("/"), suffix))


def suffixes(path: Column) -> Column:
    """All suffixes of a path at segment borders, longest first: keys for an equi-join."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def short_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(kind + ":"), F.substring(F.sha2(key, 256), 1, 16))


def base_name(path: Column) -> Column:
    """Last segment without extension, then without .test or .spec."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""), r"\.(test|spec)$", "")


def _alternatives(glob: str, i: int) -> tuple[list[str], int]:
    """The alternatives of the braces that open at i, and the place after them; none if they aren't closed."""
    depth, parts, start = 0, [], i + 1
    for j in range(i, len(glob)):
        c = glob[j]
        if c == "{":
            depth += 1
        elif c == "}" or (c == "," and depth == 1):
            if c == "}":
                depth -= 1
            if depth == (1 if c == "," else 0):
                parts.append(glob[start:j])
                start = j + 1
            if not depth:
                return parts, j + 1
    return [], i


def _class(glob: str, i: int) -> tuple[str, int]:
    """The class of characters that opens at i as a regular expression, and the place after it; empty if it isn't one."""
    j = i + 1 + (glob[i + 1 : i + 2] in ("!", "^"))
    close = glob.find("]", j + 1)
    if close < 0 or close == j:
        return "", i
    inside = re.sub(r"([\\\[\]^&~])", r"\\\1", glob[j:close])
    return ("[^/" if j > i + 1 else "[") + inside + "]", close + 1


def _glob_body(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "(?:/.*)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and _class(glob, i)[0]:
            found, i = _class(glob, i)
            out += found
        elif c == "{" and _alternatives(glob, i)[0]:
            parts, i = _alternatives(glob, i)
            out += "(?:" + "|".join(map(_glob_body, parts)) + ")"
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def glob_regex(glob: str, basename_fallback: bool = True) -> str:
    """A doublestar glob (classes, nested braces, backslash escapes) as a regular expression; a glob without a slash may
    also match the last segment."""
    lead = "(?:.*/)?" if basename_fallback and "/" not in glob else ""
    return f"^{lead}{_glob_body(glob)}$"


def owner_regex(pattern: str) -> str:
    """A code-owner pattern: a leading slash anchors, a trailing one owns the subtree."""
    anchored, p = pattern.startswith("/"), pattern.lstrip("/")
    if p.endswith("/"):
        body = glob_regex(p + "**", False)[1:-1]
        return f"^{body}$"
    a, b = glob_regex(p, False)[1:-1], glob_regex(p + "/**", False)[1:-1]
    lead = "(?:.*/)?" if not anchored and "/" not in p else ""
    return f"^{lead}(?:{a}|{b})$"


def normal_remote(url: Column) -> Column:
    """host/owner/repo of https, ssh and scp-like remotes."""
    x = F.regexp_replace(F.trim(url), r"\.git$", "")
    x = F.regexp_replace(x, r"^[A-Za-z+]+://", "")
    x = F.regexp_replace(x, r"^[^@/]*@", "")
    return F.regexp_replace(x, r"^([^/:]+):", "$1/")
