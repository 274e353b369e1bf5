import random

import pytest
from oracle import assert_matches

from cairnspark.functions import paths, scoring
from cairnspark.operators import analysis, evaluation, traversal
from cairnspark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, name):
    assert_matches(registry.QUERIES[name](spark, "/root/testdata/sf0.001"), registry.ORACLE_SQL[name], "/root/testdata/sf0.001")


def graph(spark, edges, classes=()):
    ids = sorted({x for e in edges for x in e[:2]})
    nodes = spark.createDataFrame([(i, "class" if i in classes else "function", i, False, False) for i in ids], "id string, type string, name string, is_export boolean, is_test boolean")
    return nodes, spark.createDataFrame([(*e, *("CALLS", "EXACT")[len(e) - 2 :]) for e in edges], "source string, target string, type string, confidence string")


def reach(spark, edges, seed, depth=5, classes=()):
    n, e = graph(spark, edges, classes)
    return {r["id"]: r for r in traversal.blast_radius(n, e, spark.createDataFrame([(seed,)], "id string"), depth).collect()}


def test_depths_and_bound(spark):
    got = reach(spark, [("main", "run"), ("run", "helper"), ("utils", "helper")], "helper")
    assert {k: r["depth"] for k, r in got.items()} == {"helper": 0, "run": 1, "utils": 1, "main": 2}
    assert set(reach(spark, [("c", "b"), ("b", "a")], "a", 1)) == {"a", "b"}


def test_weakest_confidence_and_path(spark):
    got = reach(spark, [("mid", "seed", "CALLS", "EXACT"), ("caller", "mid", "CALLS", "HEURISTIC")], "seed")
    assert (got["mid"]["confidence"], got["caller"]["confidence"], got["caller"]["parent"]) == ("EXACT", "HEURISTIC", "mid")
    assert got["caller"]["path"] == ["seed", "mid", "caller"]


def test_calls_into_classes_do_not_spread(spark):
    got = reach(spark, [("K", "render", "CONTAINS", "EXACT"), ("real", "render"), ("userA", "K"), ("userB", "K")], "render", classes=("K",))
    assert set(got) == {"render", "K", "real"}


def test_random_depths_against_plain_search(spark):
    random.seed(3)
    names = [f"f{i}" for i in range(30)]
    edges = [(random.choice(names), random.choice(names)) for _ in range(60)]
    want, frontier = {"f0": 0}, ["f0"]
    for d in range(1, 6):
        frontier = sorted({a for a, b in edges if b in frontier and a not in want})
        want |= dict.fromkeys(frontier, d)
    if any("f0" in e for e in edges):
        assert {k: r["depth"] for k, r in reach(spark, edges, "f0").items()} == want


def test_shortest_path(spark):
    _, e = graph(spark, [("f1", "f2"), ("f2", "f3"), ("f3", "f4"), ("f5", "f1")])
    assert traversal.shortest_path(e, "f1", "f3") == ["f1", "f2", "f3"]
    assert traversal.shortest_path(e, "f4", "f2", reverse=True) == ["f4", "f3", "f2"]
    assert traversal.shortest_path(e, "f1", "f1") == ["f1"]
    assert traversal.shortest_path(e, "f4", "f1") is None


def test_risk_ladder(spark):
    rows = [(0, 0, 2, 15), (1, 0, 2, 7), (0, 0, 2, 4), (1, 0, 2, 1), (0, 0, 3, 1), (1, 0, 1, 1), (1, 1, 1, 0), (1, 1, 1, 12), (1, 0, 1, 0), (0, 0, 2, 2)]
    df = spark.createDataFrame([(i, bool(a), bool(b), c, d) for i, (a, b, c, d) in enumerate(rows)], "i int, e boolean, t boolean, d int, p int")
    got = [r[1] for r in sorted(df.select("i", scoring.risk(df.e, df.t, df.d, df.p)).collect())]
    assert got == "HIGH HIGH MEDIUM MEDIUM LOW MEDIUM LOW HIGH MEDIUM LOW".split()


def test_globs_and_owners():
    import re

    files = ["vendor/a/b.go", "dist/x.js", "src/a.js", "src/b.go", "c.go"]
    kept = lambda *globs: sum(not any(re.search(paths.glob_regex(g), f) for g in globs) for f in files)
    assert (kept("vendor/**"), kept("vendor/**", "dist/**"), kept("*.js"), kept()) == (4, 3, 3, 5)
    assert re.search(paths.owner_regex("/internal/"), "internal/a/b.go") and not re.search(paths.owner_regex("/internal/"), "x/internal/a.go")
    assert re.search(paths.owner_regex("*.go"), "deep/er/x.go")


def test_paths(spark):
    df = spark.createDataFrame([("a//b/./c/../d",), ("/x/../../y",), ("..\\z",), ("",)], "p string")
    assert [r[0] for r in df.select(paths.canonical(df.p)).collect()] == ["a/b/d", "/y", "../z", "."]
    df = spark.createDataFrame([("https://h.com/o/r.git",), ("git@h.com:o/r.git",), ("ssh://git@h.com/o/r",), ("",)], "p string")
    assert [r[0] for r in df.select(paths.normal_remote(df.p)).collect()] == ["h.com/o/r"] * 3 + [""]


def test_tiers_stop_on_ambiguity(spark):
    df = spark.createDataFrame([("k1", 1, "a", "EXACT"), ("k1", 1, "b", "EXACT"), ("k1", 2, "c", "EXACT"), ("k2", 2, "c", "HEURISTIC")], "k string, tier int, id string, confidence string")
    got = {r["k"]: (r["id"], r["status"]) for r in analysis.resolve_tiers(df, ["k"]).collect()}
    assert got == {"k1": (None, "AMBIGUOUS"), "k2": ("c", "HEURISTIC")}


@pytest.mark.parametrize("rows, want", [([(2, 1), (1, 0)], 1.0), ([(1, 1), (2, 0)], 0.0), ([(1, 1), (1, 0)], 0.5), ([(1, 0)], 0.5)])
def test_auc(spark, rows, want):
    assert evaluation.auc(spark.createDataFrame(rows, "score int, label int")).first()["auc"] == want
