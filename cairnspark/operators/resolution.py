"""Imports, base classes, methods and scopes resolved by equi-joins on pre-aggregated keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.functions import paths as P
from cairnspark.operators.analysis import first_tier

# How a relative import may be completed, in this order.
ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def segments(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def longest_suffix_import(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports: path; files: dir, id. The directory that shares most trailing segments with the import.

    Directories are aggregated per suffix first, so each suffix of an import meets one row. The longest
    suffix with any directory decides; a tie between directories leaves the import unresolved (no row)."""
    per_dir = files.groupBy("dir").agg(F.min("id").alias("id"))
    known = per_dir.select("dir", "id", F.explode(P.suffixes(F.col("dir"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("dirs"), F.min("id").alias("id"))
    asked = imports.select("path").distinct().select("path", F.explode(P.suffixes(F.col("path"))).alias("key"))
    best = asked.join(known, "key").groupBy("path").agg(F.max(F.struct(segments(F.col("key")).alias("n"), "dirs", "id")).alias("m"))
    return best.filter("m.dirs = 1").select("path", F.col("m.id").alias("id"), F.col("m.n").cast("long").alias("segments"))


def relative_import(imports: DataFrame, files: DataFrame, endings: list[str] = ENDINGS) -> DataFrame:
    """imports: from_dir, path (starting with a dot); files: file_path, id. The first ending that names a file decides."""
    base = P.canonical(F.concat_ws("/", "from_dir", "path"))
    tries = imports.filter(F.col("path").startswith(".")).select("from_dir", "path", F.posexplode(F.array(*(F.concat(base, F.lit(e)) for e in endings))).alias("rank", "file_path"))
    found = tries.join(files.select("file_path", "id"), "file_path")
    return found.groupBy("from_dir", "path").agg(F.min_by("id", F.struct("rank", "id")).alias("id"))


def base_classes(uses: DataFrame, classes: DataFrame) -> DataFrame:
    """uses: child, base, file_path, package; classes: id, name, file_path, package. Same file, then same
    package, then the only class of that name anywhere (a guess); several at one tier are ambiguous; a class is not its own base.

    Classes are aggregated per name and place first, so a name that a million files define costs each use one row a tier."""
    defs = classes.select("id", F.col("name").alias("base"), F.col("file_path").alias("f"), F.col("package").alias("p"))
    own = defs.select(F.col("id").alias("child"), "base", F.lit(1).alias("own")).distinct()
    asked = uses.select("child", "base", F.col("file_path").alias("f"), F.col("package").alias("p")).distinct().join(own, ["child", "base"], "left")
    found = None
    for tier, (key, confidence) in enumerate(((["base", "f"], "EXACT"), (["base", "p"], "EXACT"), (["base"], "HEURISTIC")), 1):
        per = defs.groupBy(*key).agg(F.countDistinct("id").alias("all"), F.min("id").alias("lo"), F.max("id").alias("hi"))
        here = asked.join(per, key).withColumn("n", F.col("all") - F.coalesce("own", F.lit(0)))  # its own definition is of its own place
        other = F.when((F.col("n") < F.col("all")) & (F.col("lo") == F.col("child")), F.col("hi")).otherwise(F.col("lo"))
        rows = here.filter("n > 0").select("child", "base", F.lit(tier).cast("long").alias("tier"), "n", other.alias("id"), F.lit(confidence).alias("confidence"))
        found = rows if found is None else found.unionByName(rows)
    return first_tier(found, ["child", "base"])


def method_owners(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """methods: id, receiver, file_path, dir; classes: class_id, name, file_path, dir. A class of the same
    file, else of the same directory; the least id where several qualify.

    Classes are aggregated per place first, so a name that a directory has often costs each method two rows."""
    c = classes.select("class_id", F.col("name").alias("receiver"), "file_path", "dir")
    near = c.groupBy("receiver", "dir", "file_path").agg(F.min("class_id").alias("near"))
    far = near.groupBy("receiver", "dir").agg(F.min("near").alias("far"))
    found = methods.join(far, ["receiver", "dir"]).join(near, ["receiver", "dir", "file_path"], "left")
    own = F.struct(F.col("near").isNull().alias("far"), F.coalesce("near", "far").alias("class_id"))
    return found.groupBy("id").agg(F.min(own).alias("m")).select("id", "m.class_id")


#: Lines of a bin: a span meets a line through the bins that it covers.
BIN = 128


def holding(sites: DataFrame, spans: DataFrame) -> DataFrame:
    """sites: file_path, line and more; spans: file_path, start_line, end_line and more. Pairs where the span holds the line.

    An equi-join on the file and a bin of lines, the range as its residue: a site meets the spans of its bin, not of its file."""
    cover = F.sequence(F.floor(F.col("start_line") / BIN), F.floor(F.greatest("start_line", "end_line") / BIN))
    binned = spans.filter("start_line <= end_line").withColumn("__bin", F.explode(cover))
    return sites.withColumn("__bin", F.floor(F.col("line") / BIN)).join(binned, ["file_path", "__bin"]).filter("line BETWEEN start_line AND end_line").drop("__bin")


def scope_of(refs: DataFrame, scopes: DataFrame) -> DataFrame:
    """refs: ref, file_path, line, target; scopes: id, file_path, start_line, end_line. Of the scopes that hold
    the line (one-line scopes hold all lines after them), the one that starts last, then ends first; never the target.

    Of the scopes that share a file and lines, the two least ids count. Lines that references are on, each once, meet those of
    several lines by bins; of those of one line a running maximum over the lines of a file finds the last two lines that have
    any. A line keeps its best scope and the best of another id, and references pick by an equi-join on their line."""
    asked = refs.select("ref", "file_path", "line", "target").distinct()
    lines = asked.select("file_path", "line").distinct()
    place = ["file_path", "start_line", "end_line"]
    least = Window.partitionBy(*place).orderBy("id")  # cut to two rows in every task before it is shuffled
    two = scopes.select(*place, "id").distinct().withColumn("r", F.row_number().over(least)).filter("r <= 2")
    two = two.groupBy(*place).agg(F.min("id").alias("x"), F.max(F.when(F.col("r") == 2, F.col("id"))).alias("y"))
    key = lambda start, end, id_: F.when(id_.isNotNull(), F.struct((-start).alias("s"), end.alias("e"), id_.alias("i")))
    of = lambda id_: key(F.col("start_line"), F.col("end_line"), F.col(id_))
    held = holding(lines, two.filter("start_line < end_line"))
    held = held.withColumn("a", F.min(of("x")).over(Window.partitionBy("file_path", "line")))
    other = F.when(F.col("x") != F.col("a.i"), of("x")).otherwise(of("y"))
    inside = held.groupBy("file_path", "line").agg(F.first("a").alias("a"), F.min(other).alias("b"))

    one = two.filter("start_line = end_line").select("file_path", F.col("start_line").alias("line"), F.struct(F.col("start_line").alias("at"), "x", "y").alias("s"))
    last = Window.partitionBy("file_path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("before", F.max("s").over(last))
    rows = one.select("file_path", "line", F.lit(0).alias("kind"), F.struct("s", "before").alias("w"))
    rows = rows.unionByName(lines.select("file_path", "line", F.lit(1).alias("kind"), F.lit(None).cast(rows.schema["w"].dataType).alias("w")))
    so_far = Window.partitionBy("file_path").orderBy("line", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("w", F.last("w", ignorenulls=True).over(so_far)).filter("kind = 1 AND w IS NOT NULL")
    now, prior = F.col("w.s"), F.col("w.before")
    alone = lambda s, id_: key(s["at"], s["at"], s[id_])
    above = seen.select("file_path", "line", alone(now, "x").alias("c"), F.coalesce(alone(now, "y"), alone(prior, "x")).alias("d"))

    known = lines.join(inside, ["file_path", "line"], "left").join(above, ["file_path", "line"], "left")
    differs = lambda c: F.when(F.col(f"{c}.i") != F.col("target"), F.col(c))
    best = F.least(F.coalesce(differs("a"), differs("b")), F.coalesce(differs("c"), differs("d")))
    found = asked.join(known, ["file_path", "line"]).select("ref", "file_path", best.alias("m")).filter("m IS NOT NULL")
    return found.groupBy("ref", "file_path").agg(F.min("m").alias("m")).select("ref", "file_path", F.col("m.i").alias("scope"))


def nearest_marker(paths: DataFrame, markers: DataFrame) -> DataFrame:
    """paths: path; markers: dir. The deepest ancestor directory of a path that holds a marker ('.' is the root).

    Directories are looked up, each once; their paths join the answer. The root, which all have above them, is no key of a join."""
    parts, up = F.split("path", "/"), F.split("home", "/")
    home = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))
    each = paths.filter("path IS NOT NULL").select("path", home.alias("home")).distinct()
    above = F.transform(F.sequence(F.lit(1), F.size(up)), lambda i: F.array_join(F.slice(up, F.lit(1), i), "/"))
    known = markers.select("dir").distinct()
    dirs = each.filter("home IS NOT NULL").select("home").distinct().select("home", F.posexplode(above).alias("depth", "dir"))
    best = dirs.join(known, "dir").groupBy("home").agg(F.max_by("dir", "depth").alias("dir"))
    root = known.filter("dir = '.'").agg(F.max("dir").alias("root"))  # one row, null without a marker there
    return each.join(best, "home", "left").crossJoin(F.broadcast(root)).select("path", F.coalesce("dir", "root").alias("dir")).filter("dir IS NOT NULL")


def line_span(r: Column) -> Column:
    """0-based [line, col, (line,) col] as 1-based start and end lines."""
    start = F.element_at(r, 1) + 1
    return F.struct(start.alias("start_line"), F.when(F.size(r) >= 4, F.try_element_at(r, F.lit(3)) + 1).otherwise(start).alias("end_line"))


def roles(mask: Column) -> Column:
    """Bits of an occurrence: 1 defines, 2 imports."""
    return F.struct((mask.bitwiseAND(1) != 0).alias("defines"), (mask.bitwiseAND(2) != 0).alias("imports"))
