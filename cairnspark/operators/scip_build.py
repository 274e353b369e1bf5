"""The graph of SCIP documents: definitions as nodes, references as CALLS, import roles and relationships as edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.functions import paths as P
from cairnspark.operators import resolution as R
from cairnspark.operators.build import file_id, in_order, place
from cairnspark.sources.scip import project_documents

# Symbol kinds of the public SCIP schema that are callable, that are classes, and that are neither.
CALLABLE = {"Constructor": 9, "Function": 17, "Macro": 25, "Method": 26}
CLASSES = {"Class": 7, "Enum": 11, "Interface": 21, "Object": 33, "Struct": 49, "Trait": 53, "Type": 54}
OTHER = {"Constant": 8, "Field": 15, "Module": 29, "Namespace": 30, "Package": 35, "Parameter": 37, "Property": 41, "Variable": 61}


def descriptor(symbol: Column) -> Column:
    return F.element_at(F.split(F.trim(symbol), r"\s+"), -1)


def short_name(symbol: Column) -> Column:
    """The last name of a descriptor: without folders, receiver, owner, suffixes and backquotes."""
    x = F.regexp_replace(descriptor(symbol), r"^.*/(?=.)", "")
    x = F.regexp_replace(F.regexp_replace(x, r"^`|`$", ""), r"^\([^)]*\)\.", "")
    x = F.regexp_replace(x, r"^.*#(?=.)", "")
    x = F.regexp_replace(F.regexp_replace(x, r"[.#:/)]+$", ""), r"[(\[].*$", "")
    return F.regexp_replace(x, r"^`+|`+$", "")


def node_type(symbol: Column, kind: Column) -> Column:
    """function, class or null: by the kind where it says so, else by the descriptor's punctuation."""
    d = descriptor(symbol)
    by_mark = F.when(d.contains("("), "function").when(d.contains("#") & d.endswith("."), "function").when(d.rlike("[#:]$"), "class")
    known = lambda m: kind.isin(list(m.values()))
    return F.when(known(CALLABLE), "function").when(known(CLASSES), "class").when(~known(OTHER) | kind.isNull(), by_mark)


def symbols(docs: DataFrame) -> DataFrame:
    """What is known of each symbol; later documents and external symbols overwrite."""
    s = docs.select("at", "ord", F.posexplode("symbols").alias("pos", "s"))
    return s.groupBy("s.symbol").agg(F.max_by("s", F.struct("at", "ord", "pos")).alias("s")).select("s.*")


def is_test(path: Column) -> Column:
    return F.lower(path).rlike(r"(_test\.|\.test\.|\.spec\.|(^|/)(tests?|__tests__)/|(^|/)test_[^/]*$)")


def callable_there(defs: DataFrame, lines: DataFrame) -> DataFrame:
    """Definitions that are functions by a member's descriptor alone must have `name(` on their line; a line that isn't
    known counts as if it had."""
    member = descriptor(F.col("symbol"))
    unsure = (F.col("type") == "function") & ~F.coalesce(F.col("kind").isin(list(CALLABLE.values())), F.lit(False)) & ~member.contains("(")
    at = lines.select("file_path", F.col("line").alias("start_line"), F.col("text").alias("__text"))
    found = defs.join(at, ["file_path", "start_line"], "left")
    return found.filter(~(unsure & (F.col("name") != "") & F.coalesce(~F.col("__text").contains(F.concat("name", F.lit("("))), F.lit(False)))).drop("__text")


def widened(defs: DataFrame, parsed: DataFrame) -> DataFrame:
    """defs with the ends of Go functions that the native parse of their file (see sources.files.parse) finds further down."""
    f = parsed.filter("language = 'go'").select("file_path", F.inline("functions"))
    ends = f.groupBy("file_path", "start_line").agg(F.max("end_line").alias("__end"), F.lit("function").alias("type"))
    found = defs.join(ends, ["file_path", "start_line", "type"], "left")
    return found.withColumn("end_line", F.greatest("end_line", F.coalesce("__end", F.col("end_line")))).drop("__end")


def edge_counts(edges: DataFrame) -> DataFrame:
    """How many edges there are of each type."""
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def build(docs: DataFrame, lines: DataFrame | None = None, parsed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes, edges. Symbols without a definition in the project give no node, references to them no edge. A symbol has a node in
    each file that defines it, of that file's lines; references mean the last of them. Edges are numbered (edge_ord): what files contain, by
    document and occurrence; what classes contain and relationships, by symbol; imports and calls, by document and occurrence.

    lines: source lines (sources.scip.source_lines), to see whether a member can be called; parsed: parsed files, whose
    ends of Go functions widen those of the index. A reference into another package also imports that package's first file."""
    info = symbols(docs)
    doc = F.concat_ws(":", "at", F.lpad(F.col("ord").cast("string"), 12, "0"))  # in the order of the indexes and of their documents
    mine = project_documents(docs).withColumn("file_path", P.canonical(F.col("relative_path"))).withColumn("doc", doc)
    occ = mine.select("doc", "file_path", "language", F.posexplode("occurrences").alias("n", "o")).select("doc", "file_path", "language", "n", "o.*")
    occ = occ.filter("symbol != ''").withColumn("span", R.line_span(F.col("range"))).withColumn("role", R.roles(F.col("roles")))
    wide = F.when(F.size("enclosing") >= 3, R.line_span(F.col("enclosing"))).otherwise(F.col("span"))
    defs = occ.filter("role.defines AND NOT symbol LIKE 'local %'").select("doc", "file_path", "n", "language", "symbol", wide.alias("w"))
    seen = F.struct("doc", "n", "language")
    defs = defs.groupBy("symbol", "file_path").agg(F.min("w.start_line").alias("start_line"), F.max("w.end_line").alias("end_line"), F.min(seen).alias("first"), F.max(seen).alias("last"))
    defs = defs.withColumn("language", F.col("first.language"))
    defs = defs.join(info, "symbol", "left").withColumn("type", node_type(F.col("symbol"), F.col("kind"))).filter("type IS NOT NULL")
    name = F.coalesce(F.nullif(short_name(F.col("display_name")), F.lit("")), short_name(F.col("symbol")))
    parts = F.split("symbol", r"\s+")
    package = F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit(""))
    defs = defs.withColumn("id", P.short_id("scip", F.concat_ws(":", "symbol", "file_path"))).withColumn("name", name).withColumn("package", package).withColumn("is_test", is_test(F.col("file_path")))
    if lines is not None:
        defs = callable_there(defs, lines)
    if parsed is not None:
        defs = widened(defs, parsed)
    no, zero = F.lit(False), F.lit(0)
    cols = ["id", "type", "name", "file_path", "start_line", "end_line", "package", "language", "is_export", "is_test", "is_init"]
    f = mine.groupBy("file_path").agg(F.min("language").alias("language"))
    files = f.select(
        file_id(F.col("file_path")).alias("id"), F.lit("file").alias("type"), F.element_at(F.split("file_path", "/"), -1).alias("name"), "file_path",
        zero.alias("start_line"), zero.alias("end_line"), F.lit("").alias("package"), "language", no.alias("is_export"), is_test(F.col("file_path")).alias("is_test"), no.alias("is_init"),
    )
    export = F.col("name").rlike("^[A-Z]")
    nodes = files.unionByName(defs.withColumn("is_export", export).withColumn("is_init", no).select(*cols))

    known = defs.select("symbol", "last", F.struct(F.col("id").alias("target"), F.col("file_path").alias("target_file"), F.col("type").alias("target_type"), F.col("package").alias("target_package")).alias("k"))
    known = known.groupBy("symbol").agg(F.max_by("k", "last").alias("k")).select("symbol", "k.*")
    # a file's package is the least of its definitions'; a package's file the one with the least id, tests aside
    own = defs.filter("package != ''").groupBy("file_path").agg(F.min("package").alias("package"))
    stands = own.filter(~is_test(F.col("file_path"))).groupBy("package").agg(F.min(file_id(F.col("file_path"))).alias("stands_for"))
    refs = occ.filter("NOT role.defines").select("doc", "file_path", "n", F.col("span.start_line").alias("line"), "role", "symbol").join(known, "symbol")
    one = lambda df, s, t, kind, at: df.select(s.alias("source"), t.alias("target"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), at.alias("at"))
    met = lambda part: place(3, F.col("doc"), 0, F.col("n"), F.lit(part))
    path = F.col("file_path")
    imports = one(refs.filter("role.imports AND target_file != file_path"), file_id(path), file_id(F.col("target_file")), "IMPORTS", met(0))
    calls = refs.filter("NOT role.imports").withColumn("ref", F.concat_ws(":", "doc", F.col("n").cast("string")))
    scopes = defs.filter("type = 'function'").select("id", "file_path", "start_line", "end_line")
    inside = R.scope_of(calls.select("ref", "file_path", "line", "target"), scopes)
    calls = calls.join(inside, ["ref", "file_path"], "left").withColumn("source", F.coalesce("scope", file_id(path))).filter("source != target")
    across = calls.join(own, "file_path").filter("target_package != '' AND package != target_package")
    across = across.join(stands.withColumnRenamed("package", "target_package"), "target_package", "left")
    across = one(across, file_id(path), F.coalesce("stands_for", file_id(F.col("target_file"))), "IMPORTS", met(1)).filter("source != target")
    calls = one(calls, F.col("source"), F.col("target"), "CALLS", met(0))
    # a function sits in what its symbol says encloses it, else in what its descriptor says, if that is a class; and in its file
    contains = one(defs, file_id(path), F.col("id"), "CONTAINS", place(0, F.col("first.doc"), 0, F.col("first.n")))
    up = lambda column, name: known.select(F.col("symbol").alias(column), F.struct("target", "target_type").alias(name))
    kids = known.filter("target_type = 'function'").join(info.select("symbol", F.col("enclosing_symbol").alias("in1")), "symbol", "left")
    kids = kids.withColumn("in2", F.regexp_extract("symbol", r"^(.*#)[^#]+$", 1)).join(up("in1", "up1"), "in1", "left").join(up("in2", "up2"), "in2", "left")
    kids = kids.withColumn("up", F.coalesce("up1", "up2")).filter("up.target_type = 'class'")
    held = one(kids, F.col("up.target"), F.col("target"), "CONTAINS", place(1, F.col("symbol"), 0, F.lit(0)))
    rel = known.select("symbol", F.col("target").alias("source"), F.col("target_type").alias("type")).join(info.select("symbol", F.posexplode("relationships").alias("pos", "r")), "symbol")
    rel = rel.select("source", "type", "pos", F.col("symbol").alias("of"), "r.*").join(known, "symbol").filter("source != target")
    both, fn = (F.col("type") == "class") & (F.col("target_type") == "class"), F.col("type") == "function"
    kind = F.when(both & F.col("is_implementation"), "IMPLEMENTS").when(both & (F.col("is_type_definition") | F.col("is_reference")), "EXTENDS").when(fn & F.col("is_reference"), "CALLS")
    related = one(rel, F.col("source"), F.col("target"), kind, place(2, F.col("of"), 0, F.col("pos"))).filter("type IS NOT NULL")
    edges = in_order(contains.unionByName(held).unionByName(related).unionByName(imports).unionByName(calls).unionByName(across).withColumn("confidence", F.lit("EXACT")))
    return nodes, edges
