"""Owners of paths by the last of many rules that matches: an index of the rules that the paths look themselves up in.

Nearly all patterns say one of a few things about a path, each a key that a path can name by itself:
    a:dir   the path is dir or lies in it      (/src/, src/app, /src/app, src/**)
    d:dir   it lies in dir                     (src/*)
    s:name  a segment of it is name            (name, **/name)
    e:.ext  a segment of it ends so            (*.go)
Of the rules of one key only the last counts, so the index has a row a key, and a path meets it through its folders, its
segments and their endings: one equi-join and a maximum, however many rules there are. A pattern with other wildcards is checked by
its regular expression, for the paths in the folder that it begins with (w:dir); one that begins with a wildcard is checked
for all paths, those together in one flat expression.

Null paths have no owners, nor have paths without a matching rule; repeated paths are looked up once. Of rules that share a
number the greatest pattern wins. Null patterns match nothing. A path with a line break in it is compared as a whole; by a
regular expression it may not match.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.functions.paths import owner_regex
from cairnspark.operators.analysis import last_match

WILD = r"[*?\[{\\]"


def rule_keys(pattern: Column) -> Column:
    """The key of a code-owner pattern, as above; w: with the folder before its first wildcard, which is empty where there is none."""
    p = F.regexp_replace(pattern, "^/+", "")
    rooted, plain = pattern.startswith("/"), ~p.rlike(WILD)
    inside, begin = F.regexp_extract(p, r"(?s)^(.*?)/\*\*?$", 1), F.regexp_extract(p, r"(?s)^\*\*/([^/]+)$", 1)
    literal = lambda c: (c != "") & ~c.rlike(WILD)
    key = lambda kind, c: F.concat(F.lit(kind), c)
    # a folder's pattern names a path, which has no slash behind it
    whole = literal(inside) & ~inside.endswith("/")
    return (
        F.when(plain & (p != "") & p.endswith("/") & ~p.endswith("//"), key("a:", F.regexp_replace(p, "/$", "")))
        .when(plain & (p != "") & ~p.endswith("/") & (rooted | p.contains("/")), key("a:", p))
        .when(plain & (p != "") & ~p.endswith("/"), key("s:", p))
        .when(whole & p.endswith("/**"), key("a:", inside))
        .when(whole & p.endswith("/*"), key("d:", inside))
        .when(literal(begin), key("s:", begin))
        .when(~rooted & p.rlike(r"(?s)^\*\.[^/]+$") & literal(F.substr(p, F.lit(2))), key("e:", F.substr(p, F.lit(2))))
        .otherwise(key("w:", F.regexp_extract(p, r"(?s)^([^*?\[{\\]*)/", 1)))
    )


def path_keys(path: Column) -> Column:
    """The keys that a path is met by, each once."""
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    above = F.slice(folders, F.lit(1), F.size(parts) - 1)
    ends = F.flatten(F.transform(parts, lambda x: _endings(x)))
    key = lambda kind, a: F.transform(a, lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(key("a:", folders), key("d:", above), key("w:", above), key("s:", parts), key("e:", ends)))


def _endings(segment: Column) -> Column:
    """The endings of a segment that begin with a dot."""
    dots = F.split(segment, r"\.")
    n = F.size(dots)
    every = F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.concat(F.lit("."), F.array_join(F.slice(dots, i, n), ".")))
    return F.when(n > 1, every).otherwise(F.expr("cast(array() as array<string>)"))


def _expressions(rules: DataFrame) -> DataFrame:
    """rules with a wildcard: key, ord, pattern. With regex: one a rule, made where the rule is."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(regex=[owner_regex(p) for p in batch["pattern"]])

    return rules.mapInPandas(add, "key string, ord long, pattern string, regex string")


def index(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rules: ord, pattern. By key the last rule (key, ord, pattern), and the last of each pattern with wildcards (key, ord, pattern, regex)."""
    keyed = rules.filter("pattern IS NOT NULL AND ord IS NOT NULL").select(rule_keys(F.col("pattern")).alias("key"), F.col("ord").cast("long").alias("ord"), "pattern")
    wild = F.col("key").startswith("w:")
    plain = keyed.filter(~wild).groupBy("key").agg(F.max(F.struct("ord", "pattern")).alias("m")).select("key", "m.*")
    return plain, _expressions(keyed.filter(wild).groupBy("key", "pattern").agg(F.max("ord").alias("ord")).select("key", "ord", "pattern"))


def owners(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths: path and more; rules: ord, pattern, owners. paths with owners (or with the rules' owners in place of a column
    of that name), null where no rule matches."""
    plain, wild = index(rules)
    each = paths.filter("path IS NOT NULL").select("path").distinct()
    met = each.select("path", F.explode(path_keys(F.col("path"))).alias("key"))
    by_key = met.join(plain, "key").select("path", "ord", "pattern")
    within = met.filter(F.col("key").startswith("w:")).join(wild.filter("key != 'w:'"), "key").filter(F.expr("path RLIKE regex")).select("path", "ord", "pattern")
    # patterns that begin with a wildcard: few in a rule file, whatever the number of paths
    free = [(r["regex"], F.struct(F.lit(r["ord"]).cast("long").alias("ord"), F.lit(r["pattern"]).alias("pattern"))) for r in wild.filter("key = 'w:'").orderBy("ord", "pattern").collect()]
    hits = by_key.unionByName(within)
    if free:
        hits = hits.unionByName(each.select("path", last_match(F.col("path"), free).alias("m")).filter("m IS NOT NULL").select("path", "m.*"))
    last = hits.groupBy("path").agg(F.max(F.struct("ord", "pattern")).alias("m")).select("path", "m.*")
    who = rules.groupBy(F.col("ord").cast("long").alias("ord"), "pattern").agg(F.max("owners").alias("owners"))
    found = last.join(who, ["ord", "pattern"]).select("path", "owners")
    return paths.drop("owners").join(found, "path", "left").select(*[c for c in paths.columns if c != "owners"], "owners")
