"""Functions by name, call paths between them, and their neighbours.

One name is looked for by a scan of the functions (name_search); many by an index of the letters of names (name_index,
name_searches), so that each is compared with the functions that share its rarest three letters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.operators.traversal import shortest_path
from cairnspark.staging import staged

TIERS = ["exact", "qualified", "prefix", "substring"]
#: Candidates that an ambiguous name shows.
SHOWN = 10


def name_search(nodes: DataFrame, query: str) -> DataFrame:
    """Functions that a name may mean, best first: id, name, match_type, qualifier, tier.

    exact: the name; qualified: after the last dot the name, before it the package or its last segments; prefix: the name
    begins so, in the same case; substring: it is somewhere in it, in any case. Within a tier by id. A blank query matches nothing."""
    query = query.strip()
    name, package = F.col("name"), F.coalesce("package", F.lit(""))
    owner, _, last = query.rpartition(".")
    qualified = F.lit(bool(owner)) & (name == last) & ((package == owner) | package.endswith("/" + owner))
    tier = F.when(name == query, 0).when(qualified, 1).when(name.startswith(query), 2).when(F.lower(name).contains(query.lower()), 3)
    found = nodes.filter("type = 'function'").select("id", "name", F.concat(package, F.lit("."), name).alias("qualifier"), tier.alias("tier"))
    found = found.filter(F.col("tier").isNotNull() & F.lit(bool(query)))
    return found.select("id", "name", F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier") + 1).alias("match_type"), "qualifier", "tier").orderBy("tier", "id")


def unique_name(found: DataFrame) -> DataFrame:
    """found: id, match_type, tier of a name search. One row: id (the only match, else the only one of the best tier if that is exact or
    qualified, else null), matches, candidates (the first SHOWN where there is no id)."""
    best = F.min("tier")
    counts = found.agg(best.alias("best"), F.count(F.lit(1)).alias("matches"))
    per = found.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    first = counts.join(per, F.col("best") == F.col("tier"), "left")
    one = F.when((F.col("matches") == 1) | ((F.col("n") == 1) & (F.col("best") <= 1)), F.col("id"))
    shown = found.orderBy("tier", "id").limit(SHOWN).agg(F.sort_array(F.collect_list(F.struct("tier", "id"))).alias("c"))
    out = first.select(one.alias("id"), "matches").crossJoin(F.broadcast(shown))  # one row each
    return out.select("id", "matches", F.when(F.col("id").isNull(), F.col("c.id")).otherwise(F.expr("array()").cast("array<string>")).alias("candidates"))


def _letters(text: Column, sizes: tuple[int, ...]) -> Column:
    """The distinct runs of so many characters in a text, in lower case (with one form of the letter that has two, by place)."""
    x = F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3"))
    n = F.char_length(x)
    cut = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substr(x, i, F.lit(k)))
    runs = [F.when(n >= k, cut(k)) for k in sizes]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*runs))))


@dataclass
class NameIndex:
    names: DataFrame  # id, name, package of the functions
    kinds: DataFrame  # name, package, n: how many functions have both
    postings: DataFrame  # key, name: by runs of one to three characters (g:) and by the whole name (n:)
    counts: DataFrame  # key, n


def name_index(nodes: DataFrame) -> NameIndex:
    """The functions' names by their letters, staged. Runs of three find long names, shorter ones the names of one or two
    letters. A name that many functions have is one. Functions without a name are found by nothing; of rows that share an id
    each is found."""
    names = staged(nodes.filter("type = 'function' AND name IS NOT NULL").select("id", "name", F.coalesce("package", F.lit("")).alias("package")), "names")
    g = lambda a: F.transform(a, lambda x: F.concat(F.lit("g:"), x))
    keys = F.concat(g(_letters(F.col("name"), (1, 2, 3))), F.array(F.concat(F.lit("n:"), "name")))
    kinds = staged(names.groupBy("name", "package").agg(F.count(F.lit(1)).alias("n")), "kinds")
    postings = staged(kinds.select("name").distinct().select("name", F.explode(keys).alias("key")), "postings")
    return NameIndex(names, kinds, postings, staged(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "counts"))


def _kinds_found(index: NameIndex, asked: DataFrame) -> DataFrame:
    """The names and packages that names asked for mean: asked (trimmed), name, package, n (functions), tier.

    A name is looked up by the run of letters in it that the fewest names share, and what stands behind its last dot as
    a whole name; what is found so is checked. Repeated names are looked for once; null and blank ones match nothing."""
    q = F.trim(F.col("asked"))
    once = asked.select(q.alias("asked")).filter("asked != ''").distinct()
    last, owner = F.element_at(F.split("asked", r"\."), -1), F.regexp_replace("asked", r"(?s)\.[^.]*$", "")
    once = once.withColumns({"last": last, "owner": F.when(F.col("asked").contains("."), owner).otherwise("")})
    n = F.char_length(F.lower("asked"))
    own = F.when(n >= 3, _letters(F.col("asked"), (3,))).when(n == 2, _letters(F.col("asked"), (2,))).otherwise(_letters(F.col("asked"), (1,)))
    runs = once.select("asked", F.explode(own).alias("g")).select("asked", F.concat(F.lit("g:"), "g").alias("key")).join(index.counts, "key", "left")
    # a run that no name has: nothing to check
    rare = runs.groupBy("asked").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("m")).filter("m.n > 0").select("asked", F.col("m.key").alias("key"))
    name, package, qualified = F.col("name"), F.col("package"), F.col("owner") != ""
    # by letters: what the name alone decides; by the whole name: what its packages do, too
    near = rare.join(index.postings, "key").select("asked", "name").filter(F.lower("name").contains(F.lower("asked")) | name.startswith(F.col("asked")))
    exact = once.filter("owner != ''").select("asked", F.concat(F.lit("n:"), "last").alias("key")).join(index.postings, "key").select("asked", "name")
    qualified &= (name == F.col("last")) & ((package == F.col("owner")) | package.endswith(F.concat(F.lit("/"), "owner")))
    tier = F.when(name == F.col("asked"), 0).when(qualified, 1).when(name.startswith(F.col("asked")), 2).when(F.lower("name").contains(F.lower("asked")), 3)
    pairs = near.unionByName(exact).distinct().join(once, "asked")
    return pairs.join(index.kinds, "name").withColumn("tier", tier).filter("tier IS NOT NULL").select("asked", "name", "package", "n", "tier")


def name_searches(index: NameIndex, asked: DataFrame) -> DataFrame:
    """asked: asked, names as of name_search. What name_search finds for each: asked (trimmed), id, name, match_type, qualifier, tier."""
    found = _kinds_found(index, asked).drop("n").join(index.names, ["name", "package"])
    kind = F.element_at(F.array(*map(F.lit, TIERS)), F.col("tier") + 1)
    return found.select("asked", "id", "name", kind.alias("match_type"), F.concat("package", F.lit("."), "name").alias("qualifier"), "tier")


def unique_names(asked: DataFrame, found: DataFrame) -> DataFrame:
    """asked: asked; found: see name_searches. unique_name for each name asked for: asked (trimmed), id, matches, candidates."""
    per = found.groupBy("asked", "tier").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    return _unique(asked, per, found)


def resolved_names(index: NameIndex, asked: DataFrame) -> DataFrame:
    """unique_names of what name_searches finds, from counts by name and package and the SHOWN least ids of each: the functions
    themselves are not gone through for every name."""
    kind = ["name", "package"]
    kinds = staged(_kinds_found(index, asked), "found")
    least = Window.partitionBy(*kind).orderBy("id")  # cut to SHOWN rows in every task before it is shuffled
    first = staged(index.names.withColumn("r", F.row_number().over(least)).filter(F.col("r") <= SHOWN), "first")
    lowest = kinds.join(first.filter("r = 1").select(*kind, "id"), kind)
    per = lowest.groupBy("asked", "tier").agg(F.sum("n").alias("n"), F.min("id").alias("id"))
    return _unique(asked, per, kinds.select("asked", "tier", *kind).join(first, kind))


def _unique(asked: DataFrame, per: DataFrame, found: DataFrame) -> DataFrame:
    """per: asked, tier, n, id (the least); found: asked, tier, id, of each name and tier the SHOWN least at least."""
    best = per.groupBy("asked").agg(F.sum("n").alias("matches"), F.min(F.struct("tier", "n", "id")).alias("b"))
    one = F.when((F.col("matches") == 1) | ((F.col("b.n") == 1) & (F.col("b.tier") <= 1)), F.col("b.id"))
    best = best.select("asked", "matches", one.alias("id"))
    order = Window.partitionBy("asked").orderBy("tier", "id")  # cut to SHOWN rows in every task before it is shuffled
    first = found.select("asked", "tier", "id").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= SHOWN)
    first = first.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("r", "id"))).alias("c"))
    none = F.expr("cast(array() as array<string>)")
    every = asked.select(F.trim(F.col("asked")).alias("asked")).filter("asked IS NOT NULL").distinct()
    out = every.join(best, "asked", "left").join(first, "asked", "left")
    return out.select("asked", "id", F.coalesce("matches", F.lit(0).cast("long")).alias("matches"), F.when(F.col("id").isNull(), F.coalesce("c.id", none)).otherwise(none).alias("candidates"))


@dataclass
class Path:
    found: bool
    steps: list[dict]  # id, name, edge_type of the edge to the next step
    message: str = ""

    @property
    def length(self) -> int:
        return max(0, len(self.steps) - 1)


def call_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, reverse: bool = False) -> Path:
    """The shortest chain of calls from source to target (against the calls, if reverse)."""
    ends = {r["id"]: r["name"] for r in nodes.filter(F.col("id").isin(source, target)).select("id", "name").collect()}
    if source not in ends or target not in ends:
        return Path(False, [], "the graph lacks " + " and ".join(x for x in dict.fromkeys((source, target)) if x not in ends))
    ids = shortest_path(edges, source, target, reverse)
    if ids is None:
        return Path(False, [], f"{source} {'is not reached by' if reverse else 'does not reach'} {target}")
    names = {r["id"]: r["name"] for r in nodes.filter(F.col("id").isin(ids)).select("id", "name").collect()}
    return Path(True, [{"id": i, "name": names.get(i, ""), "edge_type": "CALLS" if k < len(ids) - 1 else ""} for k, i in enumerate(ids)])


def neighbours(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """Callers and callees of one node: direction, id, name, file_path."""
    calls = edges.filter("type = 'CALLS'")
    ends = calls.filter(F.col("target") == node_id).select(F.lit("caller").alias("direction"), F.col("source").alias("id"))
    ends = ends.unionByName(calls.filter(F.col("source") == node_id).select(F.lit("callee").alias("direction"), F.col("target").alias("id")))
    return ends.distinct().join(nodes.select("id", "name", "file_path"), "id").select("direction", "id", "name", "file_path")


def adjacency(edges: DataFrame) -> DataFrame:
    """Per node of a call: its callers and callees as sorted distinct lists. Lists grow with a node's degree: for reports over
    a part of a graph, not for joins (see neighbours)."""
    calls = edges.filter("type = 'CALLS'")
    none = F.lit(None).cast("string")
    end = lambda of, caller, callee: F.struct(F.col(of).alias("id"), caller.alias("caller"), callee.alias("callee"))
    ends = F.array(end("target", F.col("source"), none), end("source", none, F.col("target")))
    rows = calls.select(F.explode(ends).alias("e")).select("e.*")
    return rows.groupBy("id").agg(F.sort_array(F.collect_set("caller")).alias("callers"), F.sort_array(F.collect_set("callee")).alias("callees"))
