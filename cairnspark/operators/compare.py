"""Two graphs compared by what their nodes and edges are, not by their ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.functions import paths as P


def relative(path: Column, root: str = "") -> Column:
    """A path below root without it; other paths as they are."""
    p = P.canonical(path)
    if not root:
        return p
    base = F.regexp_replace(P.canonical(F.lit(root)), "/$", "")
    return F.when(base == "", p).when(p == base, ".").when(p.startswith(F.concat(base, F.lit("/"))), F.substring(p, F.length(base) + 2, F.length(p))).otherwise(p)


def package_folder(path: Column) -> Column:
    """The folder of a Go file; a path without a folder is its own."""
    p = P.canonical(path)
    return F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise(p)


def signature(kind: Column, path: Column, name: Column, root: str = "") -> Column:
    return F.concat_ws(":", kind, relative(path, root), name)


def signatures(nodes: DataFrame, edges: DataFrame, root: str = "") -> DataFrame:
    """kind (node, edge) and sig, distinct. Functions named default are left out, and edges that lack an end with them.

    A Go file's import means a package: the target is named by its folder, whichever file of it stands for it."""
    known = nodes.filter("NOT (type = 'function' AND name = 'default')")
    go = (F.col("type") == "file") & (F.col("language") == "go")
    folder = package_folder(F.col("file_path"))
    base = F.element_at(F.split(folder, "/"), -1)
    own = known.select("id", signature(F.col("type"), F.col("file_path"), F.col("name"), root).alias("sig"), F.when(go, signature(F.col("type"), folder, base, root)).alias("package_sig"))
    a = own.select(F.col("id").alias("source"), F.col("sig").alias("from"), F.col("package_sig").isNotNull().alias("go"))
    b = own.select(F.col("id").alias("target"), F.col("sig").alias("to"), "package_sig")
    to = F.when((F.col("type") == "IMPORTS") & F.col("go"), F.coalesce("package_sig", "to")).otherwise(F.col("to"))
    pairs = edges.join(a, "source").join(b, "target").select(F.lit("edge").alias("kind"), F.concat("from", F.lit(" -> "), to, F.lit(" ["), "type", F.lit("]")).alias("sig"))
    return own.select(F.lit("node").alias("kind"), "sig").unionByName(pairs).distinct()


def sides(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """kind, sig, side (missing, extra, shared) of two sets of signatures: one aggregation."""
    mark = lambda df, k: df.select("kind", "sig", F.lit(k).alias("k"))
    both = mark(base, 1).unionByName(mark(candidate, 2)).groupBy("kind", "sig").agg(F.bit_or("k").alias("k"))
    return both.select("kind", "sig", F.when(F.col("k") == 1, "missing").when(F.col("k") == 2, "extra").otherwise("shared").alias("side"))


def counts(found: DataFrame) -> DataFrame:
    """A row for each kind: base, candidate, shared, missing, extra."""
    n = lambda *s: F.count_if(F.col("side").isin(*s))
    return found.groupBy("kind").agg(n("missing", "shared").alias("base"), n("extra", "shared").alias("candidate"), n("shared").alias("shared"), n("missing").alias("missing"), n("extra").alias("extra"))


def examples(found: DataFrame, side: str, kind: str, most: int = 0) -> DataFrame:
    """The signatures of one side in order; the first most of them, if that is above 0."""
    out = found.filter((F.col("side") == side) & (F.col("kind") == kind)).select("sig").orderBy("sig")
    return out.limit(most) if most > 0 else out
