"""Calls of a history resolved at all its commits at once.

Commits are numbered; a file's version, its definitions and its calls hold from one number up to, but not including, another.
What a key knows changes only where a definition comes or goes: running sums over those points give, for each stretch between
two, how many functions the key knows, and which one where it is one (sums of the two halves of ids, of which one is left). A call
meets the stretches of its keys that its own life overlaps, is cut where they change, and in each piece its first tier that
knows its key decides. So a file that never changes costs one row, whatever the number of commits, and there is no loop over them.

A key has at most one point a commit, and a call at most two a key and commit: that bounds what is sorted or gathered for one.
Imports aren't followed over the history (their bindings would hold for stretches too): calls that need one go on to later tiers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.operators import build

KIND = "func:"


def stretches(defined: DataFrame) -> DataFrame:
    """defined: key, id (as build.func_id gives them), lo, hi. key, lo, hi, n (1, or 2 for several), id (where it is one): for each key the
    longest stretches in which it knows the same. Empty lives count for nothing; rows of one id and overlapping lives must be equal."""
    half = lambda i: F.conv(F.substr("id", F.lit(len(KIND) + i), F.lit(8)), 16, 10).cast("long")
    one = defined.filter("lo < hi AND key IS NOT NULL").select("key", "id", "lo", "hi").distinct().select("key", "lo", "hi", half(1).alias("a"), half(9).alias("b"))
    end = lambda t, sign: F.struct(F.col(t).alias("t"), F.lit(sign).alias("n"), (F.col("a") * sign).alias("a"), (F.col("b") * sign).alias("b"))
    points = one.select("key", F.explode(F.array(end("lo", 1), end("hi", -1))).alias("e")).select("key", "e.*")
    points = points.groupBy("key", "t").agg(*(F.sum(c).alias(c) for c in ("n", "a", "b")))
    w = Window.partitionBy("key").orderBy("t")  # at most a row a commit
    part = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    now = points.select("key", "t", *(F.sum(c).over(w).alias(c) for c in ("n", "a", "b")))
    now = now.select("key", "t", F.least("n", F.lit(2)).cast("int").alias("n"), F.when(F.col("n") == 1, F.concat(F.lit(KIND), part(F.col("a")), part(F.col("b")))).alias("id"))
    said = F.struct("n", "id")
    new = now.withColumn("before", F.lag(said).over(w)).filter(F.col("before").isNull() | ~said.eqNullSafe(F.col("before"))).drop("before")
    return new.withColumn("hi", F.lead("t").over(w)).filter("n > 0").select("key", F.col("t").alias("lo"), "hi", "n", "id")


def resolved(asked: DataFrame, known: DataFrame, site: list[str]) -> DataFrame:
    """asked: site, lo, hi (the life of that call), tier, key, conf, a row of nulls where it asks for nothing; known: see stretches.
    site, lo, hi, status, target: the longest stretches of a call's life with one answer, as build.resolved gives it for each commit."""
    life = [*site, "lo", "hi"]
    k = known.select("key", F.col("lo").alias("from"), F.col("hi").alias("to"), "n", "id")
    met = asked.filter("lo < hi").join(k, "key", "left")
    overlaps = (F.col("from") < F.col("hi")) & (F.col("to") > F.col("lo"))
    piece = F.when(overlaps, F.struct("tier", "n", "id", "conf", F.greatest("from", "lo").alias("from"), F.least("to", "hi").alias("to")))
    all_pieces = met.groupBy(*life).agg(F.collect_set(piece).alias("p"))
    cuts = F.array_sort(F.array_distinct(F.concat(F.transform("p", lambda x: x["from"]), F.transform("p", lambda x: x["to"]), F.array("lo", "hi"))))
    each = all_pieces.withColumn("cuts", cuts).select(*life, "p", F.posexplode(F.slice("cuts", F.lit(1), F.size("cuts") - 1)).alias("i", "a"), "cuts")
    each = each.select(*life, "a", F.col("cuts")[F.col("i") + 1].alias("b"), F.array_min(F.filter("p", lambda x: (x["from"] <= F.col("a")) & (x["to"] > F.col("a")))).alias("m"))
    status = F.when(F.col("m").isNull(), "UNRESOLVED").when(F.col("m.n") > 1, "AMBIGUOUS").otherwise(F.col("m.conf"))
    answer = each.select(*life, "a", "b", F.struct(status.alias("status"), F.when(F.col("m.n") == 1, F.col("m.id")).alias("target")).alias("s"))
    w = Window.partitionBy(*life).orderBy("a")
    first = answer.withColumn("before", F.lag("s").over(w)).filter(F.col("before").isNull() | ~F.col("s").eqNullSafe(F.col("before")))
    return first.withColumn("next", F.lead("a").over(w)).select(*site, F.col("a").alias("lo"), F.coalesce("next", "hi").alias("hi"), "s.status", "s.target")


def call_history(files: DataFrame, held: DataFrame) -> DataFrame:
    """files: parsed (see sources.files.parse) versions, each once, by file_path and content_hash; held: file_path, content_hash, lo, hi,
    the commits that have this version (several lives are several rows; those of one path don't overlap).
    file_path, content_hash, site, name, line, lo, hi, status, target of every call."""
    version = ["file_path", "content_hash"]
    lives = held.select(*version, "lo", "hi")
    none = files.sparkSession.createDataFrame([], "file_path string, alias string, b struct<path:string,symbol:string,target:string>, target_package string")
    defined = build.definitions(files, ("content_hash",)).join(lives, version)
    asked = build.tries(files, none, version=("content_hash",)).join(lives, version)
    return resolved(asked, stretches(defined), ["content_hash", *build.SITE]).select(*version, "site", "name", "line", "lo", "hi", "status", "target")
