"""Frontier loops over edges: blast radius and shortest path.

Each level joins the frontier with the edges, drops what was seen, and keeps one parent per node by a
pre-aggregated minimum of (place of the parent in the queue, order of the edge). In a blast radius, whose depth is
bounded, a place is the list of the numbers of the edges taken, so no level is sorted at all. A shortest path has no bound: it
is searched from both ends, without places, and the first path of the queue is picked from what both searches found. Levels
carry a parent each, not paths: those are rebuilt at the end, for the nodes that are asked for. The edges that the loop joins
are staged once.

The order of edges is their column edge_ord, where there is one (see graph_store); else type, source, target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.functions.scoring import weaker
from cairnspark.staging import drop_staged, grown, staged

DEFAULT_DEPTH = 5


def edge_order(edges: DataFrame) -> Column:
    """What edges are taken in the order of, as one sortable value."""
    of = [F.col("edge_ord").cast("long")] if "edge_ord" in edges.columns else [F.lit(0).cast("long")]
    return F.struct(of[0].alias("n"), F.col("type").alias("t"), F.col("source").alias("s"), F.col("target").alias("o"))


def _in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a number that grows along the order, with gaps: sorted by ranges, so no task sees all rows."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())


def traversal_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that impact runs along: calls only into functions, containment and inheritance always, imports never."""
    keep = [c for c in ("source", "target", "type", "confidence", "edge_ord") if c in edges.columns]
    callee = nodes.filter("type = 'function'").select(F.col("id").alias("target")).hint("merge")
    calls = edges.filter("type = 'CALLS'").join(callee, "target", "left_semi")
    return calls.select(*keep).unionByName(edges.filter("type IN ('CONTAINS', 'EXTENDS', 'IMPLEMENTS')").select(*keep))


def blast_radius(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = DEFAULT_DEPTH, paths: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """seeds: id, and seed_ord where their order is given (else by id). Out: id, depth, parent, parent_edge, confidence, place (in the
    queue: numbers that grow along it, of the seed and of the edges taken), and with paths also path and edge_path (see with_paths).

    Seeds that aren't nodes are left out; a node's confidence is the weakest along the way that reached it first.

    by: columns of seeds that tell searches apart, as the diffs of a history. Each has its own queue and visited nodes, all share
    the edges, which are staged once, and the levels: as many jobs as for one. by comes first in the result; null is no search."""
    by = list(by)
    seeds = seeds.dropna(subset=by) if by else seeds
    max_depth = max_depth if max_depth > 0 else DEFAULT_DEPTH
    # tables of ids grow with the graph and pack far better in files than in memory: none is broadcast by the size of its files
    inside = traversal_edges(nodes, edges).join(nodes.select(F.col("id").alias("source")).hint("merge"), "source", "left_semi")
    back = staged(_in_order(inside, [edge_order(inside), F.col("confidence")], "o").select("target", "source", "type", "confidence", "o"), "edges")
    order = F.min("seed_ord") if "seed_ord" in seeds.columns else F.lit(0)
    start = _in_order(seeds.join(nodes.select("id"), "id").groupBy(*by, "id").agg(order.cast("long").alias("first")), [F.col("first"), F.col("id")], "first")
    null, place = F.lit(None).cast("string"), F.array("first")
    frontier = staged(start.select(*by, "id", F.lit(0).alias("depth"), null.alias("parent"), null.alias("parent_edge"), F.lit("EXACT").alias("confidence"), place.alias("place")), "level")
    levels, seen = [frontier], frontier.select(*by, "id")
    for depth in range(1, max_depth + 1):
        step = frontier.select(*by, F.col("id").alias("target"), F.col("confidence").alias("so_far"), "place").join(back, "target")
        found = step.join(seen.withColumnRenamed("id", "source"), [*by, "source"], "left_anti")
        way = F.struct(F.concat("place", F.array("o")).alias("place"), F.col("target").alias("parent"), F.col("type").alias("parent_edge"), weaker(F.col("so_far"), F.col("confidence")).alias("confidence"))
        best = found.groupBy(*by, F.col("source").alias("id")).agg(F.min(way).alias("s"))
        frontier = staged(best.select(*by, "id", F.lit(depth).alias("depth"), "s.parent", "s.parent_edge", "s.confidence", "s.place"), "level")
        if frontier.isEmpty():
            break
        levels.append(frontier)
        seen = seen.unionByName(frontier.select(*by, "id"))
    drop_staged(back)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.join(with_paths(out, out, max_depth, tuple(by)), [*by, "id"]) if paths else out


def with_paths(asked: DataFrame, radius: DataFrame, max_depth: int = DEFAULT_DEPTH, by: tuple[str, ...] = ()) -> DataFrame:
    """asked: by and id. With path (ids from the seed on) and edge_path (types of the edges), by as many joins to the parents as there are levels."""
    up = radius.select(*by, F.col("id").alias("at"), F.col("parent").alias("up"), F.col("parent_edge").alias("by"))
    none = F.expr("cast(array() as array<string>)")
    now = asked.select(*by, "id").withColumns({"at": F.col("id"), "path": F.array("id"), "edge_path": none})
    for _ in range(max(max_depth, 1)):
        now = now.join(up, [*by, "at"], "left").select(
            *by,
            "id",
            F.coalesce("up", F.col("at")).alias("next"),
            F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat(F.array("up"), "path")).alias("path"),
            F.when(F.col("up").isNull(), F.col("edge_path")).otherwise(F.concat(F.array("by"), "edge_path")).alias("edge_path"),
        ).withColumnRenamed("next", "at")
    return now.drop("at")


def shortest_path(edges: DataFrame, source: str, target: str, reverse: bool = False) -> list[str] | None:
    """Ids along a shortest chain of calls, [source] if both are one, None if there is none; of several the one that a
    queue finds first (see the module for the order): the least list of the orders of its edges.

    Two searches, one from either end; each turn the one with the smaller level goes on, until a level of one meets the last
    of the other. A node behind knows its least edge on. The nodes ahead that lead to a meeting are then found level by level
    back to the source, each with its least edge on. So nothing is sorted, and ties are settled on what a shortest path can hold.

    A side's nodes are one table, appended to a level at a time, so plans don't grow with depth. The driver holds one id a
    step of the answer. Null ends of edges are no nodes."""
    if source == target:
        return [source]
    spark = edges.sparkSession
    calls = edges.filter("type = 'CALLS' AND source IS NOT NULL AND target IS NOT NULL")
    step = calls.select(F.col("target" if reverse else "source").alias("at"), F.col("source" if reverse else "target").alias("to"), edge_order(calls).alias("o"))
    step = staged(step, "edges")
    null = F.lit(None).cast("string")
    sides = [grown(spark.createDataFrame([(x,)], "id string").select("id", null.alias("next"), F.lit(0).alias("depth")), name) for x, name in ((source, "ahead"), (target, "behind"))]
    depth, size = [0, 0], [1, 1]
    level = lambda k, d: sides[k].filter(F.col("depth") == d).select("id")
    while True:
        k = int(size[1] < size[0])
        came, goes = ("to", "at") if k else ("at", "to")
        found = step.join(level(k, depth[k]).withColumnRenamed("id", came), came, "left_semi")
        found = found.join(sides[k].select(F.col("id").alias(goes)), goes, "left_anti").groupBy(F.col(goes).alias("id"))
        on = F.min(F.struct("o", "to"))["to"] if k else F.first(null)
        depth[k] += 1
        sides[k] = grown(found.agg(on.alias("next")).select("id", "next", F.lit(depth[k]).alias("depth")), into=sides[k])
        size[k] = level(k, depth[k]).count()
        met = level(0, depth[0]).join(level(1, depth[1]), "id", "left_semi")
        if not size[k] or not met.isEmpty():
            break
    path = None
    if size[k]:
        ways, good = [], met
        for d in reversed(range(depth[0])):
            near = step.join(good.select(F.col("id").alias("to")), "to", "left_semi").join(level(0, d).withColumnRenamed("id", "at"), "at", "left_semi")
            good = staged(near.groupBy(F.col("at").alias("id")).agg(F.min(F.struct("o", "to"))["to"].alias("next")), "way")
            ways.append(good)
        path = [source]
        for way in (*reversed(ways), *(sides[1].filter(F.col("depth") == d) for d in range(depth[1], 0, -1))):
            path.append(way.filter(F.col("id") == path[-1]).first()["next"])
        drop_staged(*ways)
    drop_staged(step, *sides)
    return path


def caller_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per call target: all calls, and those from production code."""
    from_ = nodes.select(F.col("id").alias("source"), "is_test").hint("merge")
    return edges.filter("type = 'CALLS'").join(from_, "source", "left").groupBy("target").agg(F.count(F.lit(1)).alias("callers"), F.count_if(~F.col("is_test")).alias("prod_callers"))
