"""Many diffs on one graph: each as a run of its own."""

import random

from pyspark.sql import functions as F

from cairnspark import api
from cairnspark.operators import traversal
from test_order import queue


def graph(spark, rng, n=40, m=130):
    names = [f"n{i:02}" for i in range(n)]
    kinds = {x: rng.choice(["function", "function", "function", "class"]) for x in names}
    own = [(rng.choice(names), rng.choice(names), rng.choice(["CALLS", "CALLS", "CALLS", "CONTAINS", "EXTENDS", "IMPORTS"]), rng.choice(["EXACT", "HEURISTIC"])) for _ in range(m)]
    rows = [(x, kinds[x], x, f"src/f{i // 4}.py", i % 4 * 10 + 1, i % 4 * 10 + 8, i % 3 == 0, False) for i, x in enumerate(names)]
    nodes = spark.createDataFrame(rows, "id string, type string, name string, file_path string, start_line long, end_line long, is_export boolean, is_test boolean")
    edges = spark.createDataFrame([(*x, k) for k, x in enumerate(own)], "source string, target string, type string, confidence string, edge_ord long").repartition(5)
    return names, kinds, own, nodes, edges


def test_a_hundred_searches_side_by_side(spark):
    rng = random.Random(8)
    names, kinds, own, nodes, edges = graph(spark, rng)
    starts = [(d, rng.choice(names)) for d in range(100)]
    seeds = spark.createDataFrame([*starts, (7, "no such node"), (None, names[0]), starts[3]], "diff long, id string").repartition(4)
    out = traversal.blast_radius(nodes, edges, seeds, by=("diff",)).collect()
    got = {}
    for r in out:
        got.setdefault(r["diff"], {})[r["id"]] = (r["depth"], r["parent"], r["parent_edge"], r["confidence"])
        assert r["path"][0] == dict(starts)[r["diff"]] and r["path"][-1] == r["id"] and len(r["path"]) == r["depth"] + 1 == len(r["edge_path"]) + 1
    assert got == {d: queue(own, kinds, x) for d, x in starts}
    assert traversal.blast_radius(nodes, edges, seeds.limit(0), by=("diff",)).count() == 0


def test_many_diffs_as_one_by_one(spark):
    rng = random.Random(9)
    names, kinds, own, nodes, edges = graph(spark, rng)
    # three functions that others call, each by its file and a line within it
    called = sorted({t for s, t, kind, _ in own if kind == "CALLS" and s != t and kinds[t] == "function"})
    a, b, c = ((f"f{i // 4}.py", i % 4 * 10 + 3) for i in map(names.index, (called[0], called[5], called[-1])))
    diff = lambda file, line: f"diff --git a/src/{file} b/src/{file}\n--- a/src/{file}\n+++ b/src/{file}\n@@ -{line} +{line} @@\n-x\n+y\n"
    texts = {"one": diff(*a), "two": diff(*b) + diff(*c), "same": diff(*a), "none": diff("f9.md", 1)}
    table = spark.createDataFrame([*texts.items(), ("null", None), (None, texts["one"])], "diff string, text string")
    cols = ["id", "depth", "confidence", "callers", "prod_callers", "risk", "reason", "score", F.array_join("path", ">").alias("path"), F.array_join("edge_path", ">").alias("by")]
    found = api.analyze_many(nodes, edges, table).select("diff", *cols).collect()
    assert {r["diff"] for r in found} == {"one", "two", "same"}
    for name in ("one", "two"):
        want = {tuple(r) for r in api.analyze(spark, nodes, edges, texts[name]).affected.select(*cols).collect()}
        assert want and {tuple(r)[1:] for r in found if r["diff"] == name} == want
    assert {tuple(r)[1:] for r in found if r["diff"] == "same"} == {tuple(r)[1:] for r in found if r["diff"] == "one"}


def test_places_are_numbers_and_equal_edges_go_by_confidence(spark):
    """A place costs a number a step, whatever the names are; edges that tie in all but confidence count as their surest."""
    rng = random.Random(10)
    names, kinds, own, nodes, edges = graph(spark, rng)
    twice = edges.filter("type != 'IMPORTS'").withColumn("confidence", F.lit("HEURISTIC")).unionByName(edges)
    seeds = spark.createDataFrame([(d, x) for d, x in enumerate(names)], "diff long, id string")
    out = traversal.blast_radius(nodes, twice, seeds, paths=False, by=("diff",))
    assert dict(out.dtypes)["place"] == "array<bigint>"
    got = {}
    for r in out.collect():
        assert len(r["place"]) == r["depth"] + 1
        got.setdefault(r["diff"], {})[r["id"]] = (r["depth"], r["parent"], r["parent_edge"], r["confidence"])
    assert got == {d: queue(own, kinds, x) for d, x in enumerate(names)}
