"""Unified diffs line by line, in columns: for diffs too large for one task (see diffs for many small ones).

A diff is a table of numbered lines; two running sums over them, of the lines that the old and the new side hold, say all that a
reader's state would:
    a hunk ends at the line that brings both sums to what its header counts, which an equi-join finds;
    added lines with no other between them share the old side's sum, removed ones the new side's, so runs are groups;
    a line of the new side has the hunk's first number plus the sum since.
What looks like a header inside a hunk is a line of it: the headers that count are those reached by going from a hunk's end to the
next header, found by doubling such steps, and only where two overlap at all. Files are told apart by how many `diff --git` lines
and pairs of `---` and `+++` came before. All running sums go by ranges, so no task sees a whole diff.

Result as diffs.parse_unified. One reading differs: a line that begins with a backslash never marks a file as binary.
Null and empty diffs change nothing; rows that share a key and place are one diff's lines in any order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.operators import ranking
from cairnspark.sources.diffs import GONE
from cairnspark.staging import drop_staged, staged

HUNK = r"^@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
END = 1 << 62


@dataclass
class Changes:
    files: DataFrame  # key, ord, path, is_new, is_deleted
    ranges: DataFrame  # key, ord, start, end


def lines_of(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line of a table of diffs."""
    return diffs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("pos", F.struct(F.col("pos").cast("long").alias("at")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """key (the file), pos, line of files that hold a diff each; a file is read by as many tasks as it has splits."""
    raw = spark.read.text(path, lineSep="\n").select("value", "_metadata.file_path", "_metadata.file_block_start")
    return raw.select(F.col("file_path").alias("key"), F.struct(F.col("file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("pos"), F.col("value").alias("line"))


def clean_path(name: Column) -> Column:
    x = F.regexp_replace(F.split(name, "\t")[0], r"^\s+|\s+$", "")
    x = F.regexp_replace(x, r'^"+|"+$', "")
    return F.when((F.char_length(x) > 2) & (x.startswith("a/") | x.startswith("b/")), F.substr(x, F.lit(3))).otherwise(x)


def _summed(lines: DataFrame) -> DataFrame:
    """key, pos (a number from 1 on), line, o and n (lines of the old and of the new side up to and with this one). Staged."""
    sign = F.substring("line", 1, 1)
    sums = {"place": F.lit(1).cast("long"), "o": (~sign.isin("+", "\\")).cast("long"), "n": (~sign.isin("-", "\\")).cast("long")}
    out = ranking.running(lines.select("key", "pos", "line"), [F.col("pos")], sums, ["key"])
    return staged(out.select("key", F.col("place").alias("pos"), "line", "o", "n"), "lines")


def _bounded(heads: DataFrame, lines: DataFrame) -> DataFrame:
    """heads with end, end_o and end_n: where a hunk's counts are met, and the sums there."""
    is_old, is_new = ~F.substring("line", 1, 1).isin("+", "\\"), ~F.substring("line", 1, 1).isin("-", "\\")
    at = F.struct(F.col("pos").alias("end"), F.col("o").alias("end_o"), F.col("n").alias("end_n"))
    old = lines.filter(is_old).select("key", F.col("o").alias("to_o"), at.alias("by_o"))
    new = lines.filter(is_new).select("key", F.col("n").alias("to_n"), at.alias("by_n"))
    h = heads.withColumns({"to_o": F.col("o") + F.col("old_count"), "to_n": F.col("n") + F.col("new_count")})
    h = h.join(old, ["key", "to_o"], "left").join(new, ["key", "to_n"], "left")
    # a count that the diff never meets: to its end
    past = F.struct(F.lit(END).alias("end"), F.lit(END).alias("end_o"), F.lit(END).alias("end_n"))
    last = F.greatest(F.coalesce("by_o", past), F.coalesce("by_n", past))
    return h.withColumn("e", last).select(*heads.columns, "e.*")


def _real(heads: DataFrame) -> DataFrame:
    """heads that aren't lines of another's hunk: going on from each hunk's end to the next header, from the first on."""
    both = heads.select("key", "pos", F.lit(0).alias("kind"), F.col("pos").alias("of")).unionByName(heads.select("key", F.col("end").alias("pos"), F.lit(1).alias("kind"), F.col("pos").alias("of")))
    count = ranking.running(both, [F.col("pos"), F.col("kind"), F.col("of")], {"i": (F.col("kind") == 0).cast("long")}, ["key"])
    turn = staged(count.groupBy("key", "of").agg(F.max(F.when(F.col("kind") == 0, F.col("i"))).alias("i"), (F.max(F.when(F.col("kind") == 1, F.col("i"))) + 1).alias("to")), "turns")
    if turn.filter("to != i + 1").isEmpty():
        return heads
    reached = staged(turn.filter("i = 1").select("key", "i"), "reached")
    jump = turn.select("key", "i", "to")
    while True:
        more = reached.join(jump, ["key", "i"]).select("key", F.col("to").alias("i")).join(turn.select("key", "i"), ["key", "i"], "left_semi").join(reached, ["key", "i"], "left_anti")
        more = staged(more, "more")
        if more.isEmpty():
            break
        reached = staged(reached.unionByName(more).distinct(), "reached")
        far = jump.select("key", F.col("i").alias("to"), F.col("to").alias("further"))
        jump = staged(jump.join(far, ["key", "to"]).select("key", "i", F.col("further").alias("to")), "jump")
    kept = turn.join(reached, ["key", "i"], "left_semi").select("key", F.col("of").alias("pos"))
    return heads.join(kept, ["key", "pos"], "left_semi")


def _marks(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lines that say something about a file: key, pos, kind (git, pair, new, gone, binary), old, new."""
    line, none = F.col("line"), F.lit(None).cast("string")
    git = line.startswith("diff --git ")
    kind = F.when(git, "git").when(line.startswith("new file mode"), "new").when(line.startswith("deleted file mode"), "gone").when(F.lower("line").contains("binary") & ~line.startswith("\\"), "binary")
    names = F.substr(line, F.lit(len("diff --git ") + 1))
    half = F.locate(" b/", names)
    split = half > 1
    old, new = F.when(split, F.substr(names, F.lit(1), half - 1)).otherwise(names), F.when(split, F.substr(names, half + 1)).otherwise(names)
    said = lines.withColumn("kind", kind).filter("kind IS NOT NULL").select("key", "pos", "kind", F.when(git, old).otherwise(none).alias("old"), F.when(git, new).otherwise(none).alias("new"))
    return said.join(pairs, ["key", "pos"], "left_anti").unionByName(pairs)


def changes(lines: DataFrame) -> Changes:
    """lines: key, pos (sortable within a key), line. The changed files of each diff in its order, binary ones left out, and the
    ranges of the new side that their hunks touch, staged."""
    lines = _summed(lines)
    plus = lines.filter(F.col("line").startswith("+++ ")).select("key", (F.col("pos") - 1).alias("pos"), F.substr(F.col("line"), F.lit(5)).alias("new"))
    pairs = lines.filter(F.col("line").startswith("--- ")).select("key", "pos", F.substr(F.col("line"), F.lit(5)).alias("old")).join(plus, ["key", "pos"])
    pairs = pairs.select("key", "pos", F.lit("pair").alias("kind"), "old", "new")
    marks = staged(_marks(lines, pairs), "marks")
    begin = marks.filter("kind IN ('git', 'pair')").groupBy("key").agg(F.min("pos").alias("begin"))

    n = lambda i, default: F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(line, r'{HUNK}', {i}), '') AS bigint)"), F.lit(default)).cast("long")
    heads = lines.filter(F.col("line").rlike(HUNK)).select("key", "pos", "o", "n", n(1, 1).alias("old_count"), n(2, 0).alias("first"), n(3, 1).alias("new_count"))
    heads = heads.join(begin, "key").filter("pos > begin").drop("begin")
    heads = staged(_bounded(heads, lines), "heads")
    heads = staged(_real(heads), "hunks")

    # runs of added lines by the old side's sum, of removed ones by the new side's
    added = lines.filter(F.col("line").startswith("+")).groupBy("key", "o").agg(F.min("pos").alias("pos"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    removed = lines.filter(F.col("line").startswith("-")).groupBy("key", "n").agg(F.min("pos").alias("pos"), F.min("o").alias("lo"), F.max("o").alias("hi"))
    runs = added.select("key", "pos", F.lit("+").alias("kind"), F.col("o").alias("by"), "lo", "hi").unionByName(removed.select("key", "pos", F.lit("-").alias("kind"), F.col("n").alias("by"), "lo", "hi"))

    null, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    every = runs.select("key", "pos", "kind", "by", "lo", "hi", text.alias("old"), text.alias("new"))
    every = every.unionByName(marks.select("key", "pos", "kind", null.alias("by"), null.alias("lo"), null.alias("hi"), "old", "new"))
    every = every.unionByName(heads.select("key", "pos", F.lit("hunk").alias("kind"), null.alias("by"), null.alias("lo"), null.alias("hi"), text.alias("old"), text.alias("new")))
    within = ranking.running(every, [F.col("pos"), F.col("kind")], {"hunk": (F.col("kind") == "hunk").cast("long")}, ["key"])
    within = staged(within, "within")
    number = within.filter("kind = 'hunk'").select("key", "pos", "hunk")
    hunks = heads.join(number, ["key", "pos"]).select("key", "hunk", F.col("o").alias("o0"), F.col("n").alias("n0"), "first", "end", "end_o", "end_n")
    at = staged(within.join(hunks, ["key", "hunk"], "left"), "at")
    inside = (F.col("pos") <= F.col("end")) & (F.col("kind") != "hunk")

    # a run may go on behind its hunk's end: the sums there cut it
    run = at.filter("kind IN ('+', '-')").filter(inside)
    place = F.col("first") - F.col("n0")
    a = run.filter("kind = '+'").select("key", "hunk", F.col("by").alias("o"), (place + F.col("lo") - 1).alias("start"), (place + F.least("hi", "end_n") - 1).alias("end"), F.lit(True).alias("add"))
    r = run.filter("kind = '-'").select("key", "hunk", F.least("hi", "end_o").alias("o"), (place + F.col("by")).alias("start"), (place + F.col("by")).alias("end"), F.lit(False).alias("add"))
    kept = a.unionByName(r).groupBy("key", "hunk", "o").agg(F.max(F.struct("add", "start", "end")).alias("m")).select("key", "hunk", "o", "m.start", "m.end")

    # files: so many `diff --git` lines before, and so many pairs since the last one
    told = at.filter("kind NOT IN ('+', '-')").filter(~F.coalesce(inside, F.lit(False))).select("key", "pos", "kind", "hunk", "old", "new")
    told = staged(ranking.running(told, [F.col("pos"), F.col("kind")], {"g": (F.col("kind") == "git").cast("long"), "p": (F.col("kind") == "pair").cast("long")}, ["key"]), "told")
    before = told.filter("kind = 'git'").select("key", "g", F.col("p").alias("p0"))
    since = F.when(F.col("g") == 0, F.col("p")).otherwise(F.greatest(F.col("p") - F.col("p0"), F.lit(1)))
    told = told.join(before, ["key", "g"], "left").withColumn("file", F.struct("g", since.alias("p"))).filter("NOT (file.g = 0 AND file.p = 0)")
    first = lambda k, v: F.min(F.when(F.col("kind") == k, v))
    pos, names = F.col("pos"), F.struct("pos", "old", "new")
    file = told.groupBy("key", "file").agg(first("git", names).alias("git"), first("pair", names).alias("pair"), *(first(k, pos).alias(k) for k in ("new", "gone", "binary")))
    unnamed = lambda k: F.coalesce(F.col(k) < F.coalesce("pair.pos", F.lit(END)), F.lit(False))
    old = F.when(F.col("pair").isNotNull(), F.col("pair.old")).when(unnamed("new"), GONE).otherwise(F.col("git.old"))
    new = F.when(F.col("pair").isNotNull(), F.col("pair.new")).when(unnamed("gone"), GONE).otherwise(F.col("git.new"))
    file = file.filter(~unnamed("binary")).select("key", "file", clean_path(old).alias("old"), clean_path(new).alias("new"))
    file = ranking.running(file, [F.col("file")], {"ord": F.lit(1).cast("long")}, ["key"])
    gone = F.col("new") == GONE
    file = staged(file.select("key", "file", (F.col("ord") - 1).cast("int").alias("ord"), F.when(gone, F.col("old")).otherwise(F.col("new")).alias("path"), (F.col("old") == GONE).alias("is_new"), gone.alias("is_deleted")), "files")
    of = told.filter("kind = 'hunk'").select("key", "hunk", "file").join(file.select("key", "file", "ord"), ["key", "file"]).select("key", "hunk", "ord")
    ranges = staged(kept.join(of, ["key", "hunk"]).select("key", "ord", "hunk", "o", "start", "end"), "ranges")
    drop_staged(lines, marks, at, within)
    return Changes(file.drop("file"), ranges)


def changed_files(found: Changes) -> DataFrame:
    """key, ord, path, is_new, is_deleted, line_ranges of a file in one row, as diffs.changed_files; ranges in their order."""
    each = found.ranges.groupBy("key", "ord").agg(F.sort_array(F.collect_list(F.struct("hunk", "o", "start", "end"))).alias("r"))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    flat = F.transform("r", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return found.files.join(each, ["key", "ord"], "left").select(*found.files.columns, F.coalesce(flat, none).alias("line_ranges"))
