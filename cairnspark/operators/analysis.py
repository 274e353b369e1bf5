"""Change analysis, hotspots, roll-ups, tiers and best matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.functions import scoring
from cairnspark.operators.traversal import blast_radius, caller_counts, with_paths
from cairnspark.staging import staged


def affected(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 5, thresholds: scoring.Thresholds = scoring.Thresholds(), paths: bool = False, stage: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Functions in the blast radius beside the seeds, with callers, risk, reason and score; with paths, also path and edge_path.

    Nodes and edges are read several times, so they are staged first; stage=False for tables that are stored as they are.
    by: see blast_radius."""
    if stage:
        nodes, edges = staged(nodes, "nodes"), staged(edges, "edges")
    radius = staged(blast_radius(nodes, edges, seeds, max_depth, paths=False, by=by), "radius")
    calls = caller_counts(nodes, edges).withColumnRenamed("target", "id")
    out = radius.filter("depth > 0").drop("place").join(nodes.filter("type = 'function'").select("id", "name", "is_export", "is_test"), "id")
    out = out.join(calls, "id", "left").na.fill(0, ["callers", "prod_callers"])
    rungs = (F.col("is_export"), F.col("is_test"), F.col("depth"), F.col("prod_callers"), thresholds)
    out = out.withColumns({"risk": scoring.risk(*rungs), "reason": scoring.reason(*rungs)})
    out = out.withColumn("score", scoring.review_score(F.col("risk"), F.col("confidence"), F.col("is_test"), F.col("depth"), F.col("prod_callers")))
    return out.join(with_paths(out, radius, max_depth, by), [*by, "id"]) if paths else out


def ranked(df: DataFrame, limit: int | None = None) -> DataFrame:
    """score down, risk, callers down, depth up, name, id: a total order."""
    out = df.orderBy(F.desc("score"), scoring.risk_order(F.col("risk")), F.desc("callers"), "depth", "name", "id")
    return out.limit(limit) if limit else out


def exit_code(df: DataFrame) -> DataFrame:
    """1 if anything is HIGH, else 2 if anything is MEDIUM, else 0."""
    return df.agg(F.when(F.count_if(F.col("risk") == "HIGH") > 0, 1).when(F.count_if(F.col("risk") == "MEDIUM") > 0, 2).otherwise(0).cast("long").alias("code"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, inbound, outbound of all ends of calls: one aggregation."""
    calls = edges.filter("type = 'CALLS'")
    one, zero = F.lit(1), F.lit(0)
    ends = F.array(F.struct(F.col("target").alias("id"), one.alias("i"), zero.alias("o")), F.struct(F.col("source").alias("id"), zero.alias("i"), one.alias("o")))
    return calls.select(F.explode(ends).alias("e")).groupBy(F.col("e.id").alias("id")).agg(F.sum("e.i").alias("inbound"), F.sum("e.o").alias("outbound"))


def hotspots(nodes: DataFrame, edges: DataFrame, languages: list[str] | None = None, ignore: Column | None = None, top: int = 0) -> DataFrame:
    """Functions by coupling (twice the calls in plus the calls out)."""
    keep = nodes.filter("type = 'function'")
    if languages:
        keep = keep.filter(F.col("language").isin(languages))
    if ignore is not None:
        keep = keep.filter(~ignore)
    coupling = 2 * F.col("inbound") + F.col("outbound")
    out = keep.join(degrees(edges), "id").select("id", "name", "language", "inbound", "outbound", coupling.alias("coupling"), scoring.hotspot_risk(F.col("inbound")).alias("risk"))
    if not top:
        return out
    return out.orderBy(F.desc("coupling"), F.desc("inbound"), "name", "id").limit(top)


def roll_up(nodes: DataFrame, edges: DataFrame, grain: str = "package") -> tuple[DataFrame, DataFrame]:
    """Super-nodes by package or file_path (files, functions) and distinct links of calls across them."""
    groups = nodes.filter("type = 'function'").groupBy(grain).agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("functions"))
    a, b = nodes.select(F.col("id").alias("source"), F.col(grain).alias("from_group")), nodes.select(F.col("id").alias("target"), F.col(grain).alias("to_group"))
    links = edges.filter("type = 'CALLS'").join(a, "source").join(b, "target").filter("from_group != to_group").select("from_group", "to_group").distinct()
    return groups, links


def function_view(nodes: DataFrame, edges: DataFrame, shown: Column) -> tuple[DataFrame, DataFrame]:
    """The functions that the condition shows, with calls in and their tier; and the calls among them."""
    some = nodes.filter("type = 'function'").filter(shown)
    calls = caller_counts(nodes, edges).select(F.col("target").alias("id"), F.col("callers").alias("inbound"))
    views = some.join(calls, "id", "left").select("id", F.coalesce("inbound", F.lit(0).cast("long")).alias("inbound"))
    ids = some.select("id")
    links = edges.filter("type = 'CALLS'").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return views.withColumn("risk", scoring.hotspot_risk(F.col("inbound"))), links.select("source", "target").distinct()


def first_tier(counted: DataFrame, key: list[str]) -> DataFrame:
    """counted: key, tier, n (targets), id (the least), confidence: a row a tier. The first tier decides: one target resolves, more are ambiguous."""
    first = counted.groupBy(*key).agg(F.min(F.struct("tier", "n", "id", "confidence")).alias("m"))
    one = F.col("m.n") == 1
    return first.select(*key, F.col("m.tier").alias("tier"), F.when(one, F.col("m.id")).alias("id"), F.when(~one, "AMBIGUOUS").otherwise(F.col("m.confidence")).alias("status"))


def resolve_tiers(candidates: DataFrame, key: list[str]) -> DataFrame:
    """candidates: key, tier, id, confidence, a row a candidate; see first_tier."""
    return first_tier(candidates.groupBy(*key, "tier").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id"), F.min("confidence").alias("confidence")), key)


def best_match(pairs: DataFrame) -> DataFrame:
    """pairs: diff_path, path. The exact path, else the longest, then the first by name."""
    w = Window.partitionBy("diff_path").orderBy(F.desc(F.col("diff_path") == F.col("path")), F.desc(F.octet_length("path")), "path")
    return pairs.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def last_match(path: Column, rules: list[tuple[str, Column]]) -> Column:
    """What the last rule (regex, value) that matches gives, null where none does: one flat expression, however many rules."""
    return F.coalesce(*(F.when(path.rlike(regex), value) for regex, value in reversed(rules))) if rules else F.lit(None)


def most_called(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """The nodes with the most calls to them."""
    calls = edges.filter("type = 'CALLS'").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    return calls.join(nodes.select("id", "name", "file_path"), "id").orderBy(F.desc("callers"), "name", "id").limit(top)


def representatives(nodes: DataFrame) -> DataFrame:
    """Per package the least id of what isn't a test."""
    return nodes.filter("NOT is_test").groupBy("package").agg(F.min("id").alias("id"))


def first_of(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """df's rows without later ones of the same key: a distinct that keeps the first. One aggregation, no sort."""
    rest = [c for c in df.columns if c not in (*key, order)]
    return df.groupBy(*key).agg(F.min(F.struct(order, *rest)).alias("m")).select(*key, "m.*").select(*df.columns)


def shown(nodes: DataFrame, edges: DataFrame, packages: list[str] = (), files: list[str] = (), node_types: list[str] = (), edge_types: list[str] = (), text: str = "") -> tuple[DataFrame, DataFrame]:
    """The part of a graph that a view shows: nodes that pass every filter given (text: somewhere in the name, in any case),
    and the edges of the types given with both ends among them."""
    keep = nodes
    for column, wanted in (("package", packages), ("file_path", files), ("type", node_types)):
        if wanted:
            keep = keep.filter(F.col(column).isin(list(wanted)))
    if text:
        keep = keep.filter(F.lower("name").contains(text.lower()))
    ids = keep.select("id")
    links = edges.filter(F.col("type").isin(list(edge_types))) if edge_types else edges
    links = links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return keep, links
