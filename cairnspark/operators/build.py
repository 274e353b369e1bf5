"""The graph of parsed files: nodes, CONTAINS, IMPORTS, EXTENDS / IMPLEMENTS and CALLS edges, and how references resolved.

Definitions are aggregated per lookup key (how many, the least id) before anything joins them, and a call site asks
for at most thirteen keys, one a tier: one equi-join and one aggregation resolve all sites, and a name that a million
files define costs one row. The first tier that knows its key decides; if it knows several targets, the site is ambiguous.
Calls that ask the same (ASK: the same name and receiver in the same file) are resolved once, and the answer joins the calls.

What works on functions and calls takes them as rows, so that no row grows with a file; functions() and calls() give them for
parsed files.

Edges have an order, edge_ord from 1 on, which traversals follow: by pass (what files contain; methods and bases; imports;
calls), in it by file path, then by place in the file. An edge that comes several times has its first place. The numbers are
given by ranges (see ranking) and are as good as rows: Parquet and JSON keep them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.functions import paths as P
from cairnspark.operators import ranking
from cairnspark.operators import resolution as R
from cairnspark.operators import types

SCRIPT = ["javascript", "typescript"]
GUESS = "HEURISTIC"


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    sites: DataFrame  # kind, file_path, line, name, status


def folder(path: Column) -> Column:
    d = F.regexp_replace(path, r"/?[^/]*$", "")
    return F.when(d == "", ".").otherwise(d)


def qualifier(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def file_id(path: Column) -> Column:
    return P.short_id("file", path)


def class_id(path: Column, name: Column) -> Column:
    return P.short_id("class", F.concat(path, F.lit(":"), name))


def func_id(path: Column, receiver: Column, name: Column, line: Column) -> Column:
    return P.short_id("func", F.concat_ws(":", path, receiver, name, line.cast("string")))


def functions(files: DataFrame, version: tuple[str, ...] = ()) -> DataFrame:
    """One row a function, in the order of its file (ord). version: columns that tell versions of one file apart."""
    of = ["file_path", *version, "language", "package", "is_test_file"]
    return identified(files.select(*of, F.posexplode("functions").alias("ord", "f")).select(*of, "ord", "f.*"))


def identified(f: DataFrame) -> DataFrame:
    """Functions as rows, with their ids."""
    return f.withColumn("id", func_id(F.col("file_path"), F.col("receiver"), F.col("name"), F.col("start_line")))


def calls(files: DataFrame, version: tuple[str, ...] = ()) -> DataFrame:
    """One row a call, in the order of its file (site). version: see functions."""
    of = ["file_path", *version, "language", "package"]
    return files.select(*of, F.posexplode("calls").alias("site", "c")).select(*of, "site", "c.*")


def classes(files: DataFrame) -> DataFrame:
    """One row a class, in the order of its file (ord)."""
    c = files.select("file_path", "language", "package", "is_test_file", F.posexplode("classes").alias("ord", "c")).select("file_path", "language", "package", "is_test_file", "ord", "c.*")
    return c.withColumn("id", class_id(F.col("file_path"), F.col("name")))


def nodes(files: DataFrame) -> DataFrame:
    """Files, functions and classes; of repeated ids one node."""
    cols = ["id", "type", "name", "file_path", "start_line", "end_line", "package", "language", "is_export", "is_test", "is_init"]
    no, zero = F.lit(False), F.lit(0).cast("long")
    a = files.select(
        file_id(F.col("file_path")).alias("id"), F.lit("file").alias("type"), F.element_at(F.split("file_path", "/"), -1).alias("name"), "file_path",
        zero.alias("start_line"), zero.alias("end_line"), "package", "language", no.alias("is_export"), F.col("is_test_file").alias("is_test"), no.alias("is_init"),
    )
    b = functions(files).withColumn("type", F.lit("function")).withColumnRenamed("is_test_file", "is_test").select(*cols)
    c = classes(files).withColumn("type", F.lit("class")).withColumnRenamed("is_test_file", "is_test").withColumn("is_init", no).select(*cols)
    every = a.unionByName(b).unionByName(c)
    return every.groupBy("id").agg(F.min(F.struct(*cols[1:])).alias("n")).select("id", "n.*")


def imports(files: DataFrame) -> DataFrame:
    """Every import with the file it means: file_path, language, path, alias, symbol, line, ord (its place in the file), target (null: outside)."""
    i = files.select("file_path", "language", F.posexplode("imports").alias("ord", "i")).select("file_path", "language", "ord", "i.*")
    known = files.select("file_path", "language", "is_test_file")
    go = known.filter("language = 'go' AND NOT is_test_file").select(folder(F.col("file_path")).alias("dir"), F.col("file_path").alias("id"))
    asked, bare = i.filter("language = 'go'"), F.trim(F.col("path"), F.lit("/"))
    met = R.longest_suffix_import(asked.select(bare.alias("path")), go).select(F.col("path").alias("p"), F.col("id").alias("target"))
    a = asked.join(met, bare == F.col("p"), "left").drop("p")

    script = i.filter(F.col("language").isin(SCRIPT)).withColumn("from_dir", folder(F.col("file_path")))
    hit = R.relative_import(script.select("from_dir", "path").distinct(), known.select("file_path", F.col("file_path").alias("id"))).withColumnRenamed("id", "target")
    b = script.join(hit, ["from_dir", "path"], "left").drop("from_dir")

    # a dotted module: so many folders up, else the only file that ends in its segments
    py = i.filter("language = 'python'").withColumn("dots", F.length(F.regexp_extract("path", r"^\.*", 0)))
    tail = F.replace(F.ltrim(F.col("path"), F.lit(".")), F.lit("."), F.lit("/"))
    up = F.concat(folder(F.col("file_path")), F.repeat(F.lit("/.."), F.greatest(F.col("dots") - 1, F.lit(0))))
    py = py.withColumn("stem", F.when(F.col("dots") > 0, P.canonical(F.concat_ws("/", up, F.nullif(tail, F.lit(""))))).otherwise(tail))
    stem = F.regexp_replace(F.regexp_replace("file_path", r"\.py$", ""), r"(^|/)__init__$", "")
    mods = known.filter("language = 'python'").select("file_path", stem.alias("stem"))
    whole = mods.groupBy("stem").agg(F.min("file_path").alias("whole"))
    ends = mods.select("file_path", F.explode(P.suffixes(F.col("stem"))).alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.min("file_path").alias("end"))
    c = py.join(whole, "stem", "left").join(ends, "stem", "left")
    c = c.withColumn("target", F.coalesce("whole", F.when((F.col("dots") == 0) & (F.col("n") == 1), F.col("end")))).drop("stem", "dots", "whole", "n", "end")
    return a.unionByName(b).unionByName(c)


def definitions(files: DataFrame, version: tuple[str, ...] = ()) -> DataFrame:
    """definitions_of the functions of parsed files."""
    return definitions_of(functions(files, version), version)


def definitions_of(f: DataFrame, version: tuple[str, ...] = ()) -> DataFrame:
    """Lookup keys of functions: file_path, version (see functions), key, id, each once. q: qualified, f: file, p: Go package, n: any name."""
    name, path, go = F.col("name"), F.col("file_path"), F.col("language") == "go"
    owned, plain = F.col("receiver") != "", ~F.col("is_init")
    k = lambda kind, *cols: F.concat(F.lit(kind), F.concat_ws(".", *cols))
    rows = F.array(
        F.when(go & owned & (F.col("package") != ""), k("q:", "package", "receiver", "name")),
        F.when(go & (F.col("package") != ""), k("q:", "package", "name")),
        F.when(~go, k("q:", P.base_name(path), name)),
        F.when(~go, k("q:", qualifier(path), name)),
        F.when(~go & owned, k("q:", "receiver", "name")),
        F.when(~go & owned, k("q:", qualifier(path), F.col("receiver"), name)),
        F.when(plain, k("f:", path, name)),
        F.when(plain & go, k("p:", "package", "name")),
        k("n:", name),
    )
    return f.select("file_path", *version, F.explode(F.array_distinct(F.array_compact(rows))).alias("key"), "id").distinct()


def targets(defined: DataFrame) -> DataFrame:
    """key, n (targets), id (the least) of definitions."""
    return defined.groupBy("key").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id"))


def bindings(files: DataFrame, bound: DataFrame) -> DataFrame:
    """What each name that a file imports is bound to, by its last import: file_path, alias, b (path, symbol, target), target_package."""
    b = bound.filter("alias != ''").groupBy("file_path", "alias").agg(F.max_by(F.struct("path", "symbol", "target"), "line").alias("b"))
    return b.join(files.select(F.col("file_path").alias("tf"), F.col("package").alias("target_package")), F.col("b.target") == F.col("tf"), "left").drop("tf")


SITE = ["file_path", "site", "name", "line"]
#: What the answer to a call depends on, beside what its file binds and knows.
ASK = ["file_path", "language", "package", "name", "receiver", "receiver_type", "receiver_key"]


def ask_of(c: DataFrame) -> list[str]:
    """The columns of ASK that calls have: those made by hand may lack the last."""
    return [x for x in ASK if x in c.columns]


def alike(a: DataFrame, b: DataFrame, on: list[str], how: str) -> DataFrame:
    """a joined with b where the columns are the same; nulls are the same as nulls."""
    other = b.withColumnsRenamed({x: f"__{x}" for x in on})
    same = reduce(Column.__and__, (F.col(x).eqNullSafe(F.col(f"__{x}")) for x in on))
    return a.join(other, same, how).drop(*(f"__{x}" for x in on))


def tries(files: DataFrame, b: DataFrame, known: DataFrame | None = None, version: tuple[str, ...] = ()) -> DataFrame:
    """tries_of the calls of parsed files: version (see functions), SITE, tier, key, conf."""
    return tries_of(calls(files, version), b, known, [*version, *SITE])


def tries_of(c: DataFrame, b: DataFrame, known: DataFrame | None, site: list[str]) -> DataFrame:
    """The keys that calls ask for: site, tier, key, conf; one row of nulls for a call that asks for none.
    b: see bindings; known: types of receivers (see types.receivers)."""
    head = F.when(F.col("receiver") != "", F.col("receiver")).otherwise(F.col("name"))
    c = c.withColumn("alias", head).join(b, ["file_path", "alias"], "left")
    # a type that the file itself shows by the call comes before one that facts lead to
    if known is not None:
        c = c.join(known, ["file_path", "receiver_key"], "left")
    else:
        c = c.withColumns({"type_home": F.lit(None).cast("string"), "type_name": F.lit(None).cast("string")})
    led = (F.col("receiver_type") == "") & F.col("type_name").isNotNull()
    recv, name, kind = F.col("receiver"), F.col("name"), F.when(led, F.col("type_name")).otherwise(F.col("receiver_type"))
    package, home = (F.when(led, F.col("type_home")).otherwise(x) for x in (F.col("package"), qualifier(F.col("file_path"))))
    go, js, has = F.col("language") == "go", F.col("language").isin(SCRIPT), recv != ""
    target = qualifier(F.col("b.target"))
    base = F.regexp_replace(F.element_at(F.split("b.path", "/"), -1), r"\.(tsx?|jsx?)$", "")
    typed = has & (kind != "")
    q = lambda *cols: F.concat(F.lit("q:"), F.concat_ws(".", *cols))
    init = go & ~has & (name == "init")
    local = F.when(has, GUESS).otherwise("EXACT")
    tiers = [
        (typed & go & (package != ""), q(package, kind, name), F.lit("EXACT")),
        (typed & go, q(kind, name), F.lit("EXACT")),
        (typed & (F.col("language") == "typescript"), q(home, kind, name), F.lit("EXACT")),
        (typed & (F.col("language") == "typescript"), q(kind, name), F.lit(GUESS)),
        (has & go & F.col("target_package").isNotNull(), q("target_package", "name"), F.lit("EXACT")),
        (has & js & target.isNotNull(), q(target, F.col("b.symbol"), name), F.lit("EXACT")),
        (has & js & target.isNotNull(), q(target, name), F.lit("EXACT")),
        (has & js & target.isNotNull(), q(base, name), F.lit("EXACT")),
        (has, q("receiver", "name"), F.lit(GUESS)),
        (~has & js & target.isNotNull(), q(target, F.col("b.symbol")), F.lit("EXACT")),
        (~init, F.concat(F.lit("f:"), F.concat_ws(".", "file_path", "name")), local),
        (~init & go, F.concat(F.lit("p:"), F.concat_ws(".", "package", "name")), local),
        (~init, F.concat(F.lit("n:"), name), F.lit(GUESS)),
    ]
    asked = F.array_compact(F.array(*(F.when(ok, F.struct(F.lit(i).alias("tier"), key.alias("key"), conf.alias("conf"))) for i, (ok, key, conf) in enumerate(tiers))))
    return c.select(*site, F.explode_outer(asked).alias("t")).select(*site, "t.*")


def resolved(asked: DataFrame, known: DataFrame, site: list[str]) -> DataFrame:
    """asked: see tries_of; known: see targets. Every site with its status (EXACT, HEURISTIC, AMBIGUOUS, UNRESOLVED) and target."""
    found = asked.join(known, "key", "left")
    first = found.groupBy(*site).agg(F.min(F.when(F.col("n").isNotNull(), F.struct("tier", "n", "id", "conf"))).alias("m"))
    status = F.when(F.col("m").isNull(), "UNRESOLVED").when(F.col("m.n") > 1, "AMBIGUOUS").otherwise(F.col("m.conf"))
    return first.select(*site, status.alias("status"), F.when(F.col("m.n") == 1, F.col("m.id")).alias("target"))


def answered(c: DataFrame, answers: DataFrame) -> DataFrame:
    """Calls with the status and target of what they ask for."""
    return alike(c, answers, ask_of(c), "inner")


def resolved_calls(c: DataFrame, b: DataFrame, known: DataFrame | None, defined: DataFrame) -> DataFrame:
    """Calls as rows, each with its status and target. b, known: see tries_of; defined: see definitions."""
    ask = ask_of(c)
    return answered(c, resolved(tries_of(c.select(*ask).distinct(), b, known, ask), targets(defined), ask))


def call_sites(files: DataFrame, bound: DataFrame) -> DataFrame:
    """Every call of parsed files, resolved."""
    b = bindings(files, bound)
    known = types.receivers(files, b) if "facts" in files.columns else None
    return resolved_calls(calls(files), b, known, definitions(files)).select(*SITE, "status", "target")


def enclosing(lines: DataFrame, f: DataFrame) -> DataFrame:
    """lines: file_path, line; f: functions. Each line once that a function holds, with the first of those in the order of the file: fid."""
    spans = f.select("file_path", "ord", "start_line", "end_line", F.col("id").alias("fid"))
    held = R.holding(lines.select("file_path", "line").distinct(), spans)
    return held.groupBy("file_path", "line").agg(F.min(F.struct("ord", "fid")).alias("o")).select("file_path", "line", "o.fid")


def callers(f: DataFrame, sites: DataFrame) -> DataFrame:
    """f: functions. Resolved sites (file_path, line, target, status and more) with their source: the first function of the file, in its
    order, that holds the line; else the file. source, target, confidence, file_path, and what else sites have."""
    asked = sites.filter("target IS NOT NULL")
    one = asked.join(enclosing(asked, f), ["file_path", "line"], "left")
    more = [c for c in sites.columns if c not in ("file_path", "line", "target", "status")]
    return one.select(F.coalesce("fid", file_id(F.col("file_path"))).alias("source"), "target", F.col("status").alias("confidence"), "file_path", *more)


#: Where an edge is emitted: the pass, the file, the part of the file that the pass takes, the place in it, and the place in that.
PLACE = ["step", "file", "part", "n", "m"]


def place(step: int, file: Column, part: int | Column, n: Column, m: Column | None = None) -> Column:
    part = part if isinstance(part, Column) else F.lit(part)
    parts = (F.lit(step), file, part.cast("int"), n.cast("long"), F.lit(0).cast("long") if m is None else m.cast("long"))
    return F.struct(*(x.alias(name) for x, name in zip(parts, PLACE, strict=True)))


def in_order(edges: DataFrame) -> DataFrame:
    """edges: source, target, type, confidence, at (see place). One row an edge, EXACT if it is anywhere, numbered in the order
    of their first places, with ties by source and target: edge_ord. Staged."""
    one = edges.groupBy("source", "target", "type").agg(F.min("confidence").alias("confidence"), F.min("at").alias("at"))
    one = one.select("source", "target", "type", "confidence", *(F.col(f"at.{c}").alias(f"at_{c}") for c in PLACE))
    order = [*(F.col(f"at_{c}") for c in PLACE), F.col("source"), F.col("target"), F.col("type")]
    return ranking.numbered(one, order, "edge_ord").select("source", "target", "type", "confidence", "edge_ord")


def file_metadata(files: DataFrame) -> DataFrame:
    """file_path, content_hash, language, node_count (functions and classes) of the files that have a hash."""
    n = F.coalesce(F.size("functions"), F.lit(0)) + F.coalesce(F.size("classes"), F.lit(0))
    return files.filter("content_hash != ''").select("file_path", "content_hash", "language", n.cast("long").alias("node_count"))


def metadata_of(parts: DataFrame) -> DataFrame:
    """file_metadata of files in parts: file_path, content_hash, language, node_count of each."""
    known = parts.filter("content_hash != ''")
    return known.groupBy("file_path", "content_hash", "language").agg(F.sum("node_count").alias("node_count"))


def resolution_stats(sites: DataFrame) -> DataFrame:
    """sites: kind, status. One row: each kind's sites by status (call_exact, ..., inheritance_unresolved)."""
    kinds, states = ("call", "inheritance"), ("EXACT", "HEURISTIC", "AMBIGUOUS", "UNRESOLVED")
    return sites.agg(*(F.count_if((F.col("kind") == k) & (F.col("status") == v)).alias(f"{k}_{v.lower()}") for k in kinds for v in states))


def resolution_issues(sites: DataFrame, most: int = 200) -> DataFrame:
    """The first ambiguous or unresolved references, those of inheritance first: the cap is this log's feature."""
    order = F.when(F.col("kind") == "inheritance", 0).otherwise(1)
    return sites.filter("status IN ('AMBIGUOUS', 'UNRESOLVED')").orderBy(order, "file_path", "line", "name", "status").limit(most)


def build(files: DataFrame, sites: DataFrame | None = None) -> Graph:
    """The graph of parsed files (`sources.files.parse`). Files without definitions give their node alone; no files, empty tables.
    sites: the resolved calls, where they are kept up (see operators.upkeep)."""
    f, c = functions(files), classes(files)
    bound = imports(files)
    sites = call_sites(files, bound) if sites is None else sites

    def edge(df: DataFrame, source, target, kind, at: Column, confidence=None) -> DataFrame:
        return df.select(source.alias("source"), target.alias("target"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("type"), (F.lit("EXACT") if confidence is None else confidence).alias("confidence"), at.alias("at"))

    path = F.col("file_path")
    owners = R.method_owners(
        f.filter("receiver != ''").select("id", "receiver", "file_path", folder(path).alias("dir")).distinct(),
        c.select(F.col("id").alias("class_id"), "name", "file_path", folder(path).alias("dir")),
    )
    owners = owners.join(f.select("id", "file_path", "ord"), "id")
    uses = c.select(F.col("id").alias("child"), "kind", "file_path", "package", "language", "ord", F.posexplode("bases").alias("pos", "base"))
    uses = uses.withColumn("base", F.element_at(F.split("base", r"\."), -1))
    kin = R.base_classes(uses.withColumn("package", F.when(F.col("language") == "go", F.col("package"))), c)
    kinds = c.select(F.col("id").alias("i"), F.col("kind").alias("base_kind"))
    kin = uses.join(kin, ["child", "base"], "left").join(kinds, F.col("id") == F.col("i"), "left")
    relation = F.when((F.col("base_kind") == "interface") & (F.col("kind") == "class"), "IMPLEMENTS").otherwise("EXTENDS")
    known = bound.filter("target IS NOT NULL AND target != file_path")
    made = callers(f, sites)
    edges = [
        edge(f, file_id(path), F.col("id"), "CONTAINS", place(0, path, 0, F.col("ord"))),
        edge(c, file_id(path), F.col("id"), "CONTAINS", place(0, path, 1, F.col("ord"))),
        edge(owners, F.col("class_id"), F.col("id"), "CONTAINS", place(1, path, 0, F.col("ord"))),
        edge(kin.filter("id IS NOT NULL"), F.col("child"), F.col("id"), relation, place(1, path, 1, F.col("ord"), F.col("pos")), F.col("status")),
        edge(known, file_id(path), file_id(F.col("target")), "IMPORTS", place(2, path, 0, F.col("ord"))),
        edge(made, F.col("source"), F.col("target"), "CALLS", place(3, path, 0, F.col("site")), F.col("confidence")),
    ]
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    out = in_order(out)
    issues = sites.select(F.lit("call").alias("kind"), "file_path", "line", "name", "status")
    lost = kin.select(F.lit("inheritance").alias("kind"), "file_path", F.lit(None).cast("long").alias("line"), F.col("base").alias("name"), F.coalesce("status", F.lit("UNRESOLVED")).alias("status"))
    return Graph(nodes(files), out, issues.unionByName(lost))
