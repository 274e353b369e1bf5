import pytest

from cairnspark import api
from cairnspark.operators import compare, ranking, search, traversal

NODE = "id string, type string, name string, package string, file_path string, language string, is_export boolean, is_test boolean"


def nodes(spark, *rows):
    return spark.createDataFrame([(i, t, n, p, f, lang, False, False) for i, t, n, p, f, lang in rows], NODE)


@pytest.fixture(scope="module")
def named(spark):
    function = lambda i, name, package: (i, "function", name, package, "x.go", "go")
    return nodes(spark, function("n1", "Build", "graph"), function("n2", "BuildGraph", "internal/graph"), function("n3", "rebuildAll", "tools"), function("n4", "build", "cmd"), function("n5", "Build", "internal/graph"), ("n6", "class", "Build", "graph", "x.go", "go"))


@pytest.mark.parametrize(
    "query, want",
    [
        ("Build", [("n1", "exact"), ("n5", "exact"), ("n2", "prefix"), ("n3", "substring"), ("n4", "substring")]),
        ("build", [("n4", "exact"), ("n1", "substring"), ("n2", "substring"), ("n3", "substring"), ("n5", "substring")]),
        ("graph.Build", [("n1", "qualified"), ("n5", "qualified")]),
        ("internal/graph.Build", [("n5", "qualified")]),
        (" BuildGraph ", [("n2", "exact")]),
        ("raph.Build", []),
        ("", []),
        ("  ", []),
    ],
)
def test_names_by_tier(named, query, want):
    assert [(r["id"], r["match_type"]) for r in search.name_search(named, query).collect()] == want


@pytest.mark.parametrize("query, want, matches", [("Build", None, 5), ("build", "n4", 5), ("graph.Build", None, 2), ("internal/graph.Build", "n5", 1), ("rebuild", "n3", 1), ("none", None, 0)])
def test_one_function_by_name(named, query, want, matches):
    row = search.unique_name(search.name_search(named, query)).first()
    assert (row["id"], row["matches"]) == (want, matches)
    assert len(row["candidates"]) == (matches if want is None else 0)


def test_why(spark, named):
    edges = spark.createDataFrame([("n3", "n4", "CALLS", "EXACT"), ("n4", "n2", "CALLS", "EXACT"), ("n2", "n6", "CONTAINS", "EXACT")], "source string, target string, type string, confidence string")
    found = api.why(named, edges, "rebuildAll", "BuildGraph")
    assert found.found and [x["name"] for x in found.steps] == ["rebuildAll", "build", "BuildGraph"] and found.length == 2
    assert [x["edge_type"] for x in found.steps] == ["CALLS", "CALLS", ""]
    assert [x["id"] for x in api.why(named, edges, "BuildGraph", "rebuildAll", reverse=True).steps] == ["n2", "n4", "n3"]
    assert search.call_path(named, edges, "n2", "n3").message == "n2 does not reach n3"
    assert search.call_path(named, edges, "n2", "zz").message == "the graph lacks zz"
    same = search.call_path(named, edges, "n2", "n2")
    assert same.found and same.length == 0 and len(same.steps) == 1
    with pytest.raises(api.Ambiguous) as e:
        api.why(named, edges, "Build", "build")
    assert e.value.candidates == ["n1", "n5", "n2", "n3", "n4"]
    assert {(r["direction"], r["id"]) for r in search.neighbours(named, edges, "n4").collect()} == {("caller", "n3"), ("callee", "n2")}
    assert {r["id"]: (r["callers"], r["callees"]) for r in search.adjacency(edges).collect()} == {"n3": ([], ["n4"]), "n4": (["n3"], ["n2"]), "n2": (["n4"], [])}


def queue_search(ids, edges, seeds, depth):
    """A queue, plainly: id -> (depth, parent, edge type, confidence). Unknown ids are marked and never go on."""
    found, seen, queue = {}, set(), []
    for s in seeds:
        if s in ids and s not in seen:
            found[s] = (0, None, None, "EXACT")
            seen.add(s)
            queue.append(s)
    for now in queue:
        if found[now][0] == depth:
            continue
        for source, target, kind, confidence in edges:
            if target == now and source not in seen:
                seen.add(source)
                if source in ids:
                    weak = "HEURISTIC" if "HEURISTIC" in (found[now][3], confidence) else "EXACT"
                    found[source] = (found[now][0] + 1, now, kind, weak)
                    queue.append(source)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_parents_are_those_of_a_queue(spark, seed):
    import random

    random.seed(seed)
    names = [f"f{i}" for i in range(14)]
    edges = [(random.choice(names), random.choice(names), random.choice(["CONTAINS", "EXTENDS", "CALLS"]), random.choice(["EXACT", "HEURISTIC"])) for _ in range(40)]
    known = names[:12]
    seeds = random.sample(names, 3)
    n = nodes(spark, *((i, "function", i, "", "x.go", "go") for i in known))
    e = spark.createDataFrame([(*x, k) for k, x in enumerate(edges)], "source string, target string, type string, confidence string, edge_ord long")
    s = spark.createDataFrame([(x, k) for k, x in enumerate(seeds)], "id string, seed_ord long")
    inside = [x for x in edges if x[2] != "CALLS" or x[1] in known]
    got = {r["id"]: (r["depth"], r["parent"], r["parent_edge"], r["confidence"]) for r in traversal.blast_radius(n, e, s, 4, paths=False).collect()}
    assert got == queue_search(set(known), inside, seeds, 4)


def test_signatures_of_nodes_and_imports(spark):
    a = nodes(spark, ("a", "file", "main.go", "", "/repo/cmd/main.go", "go"), ("b", "file", "one.go", "", "/repo/pkg/x/one.go", "go"), ("c", "function", "F", "x", "/repo/pkg/x/one.go", "go"), ("d", "function", "default", "x", "/repo/d.ts", "typescript"))
    b = nodes(spark, ("1", "file", "main.go", "", "cmd/main.go", "go"), ("2", "file", "two.go", "", "pkg/x/two.go", "go"), ("3", "function", "F", "x", "pkg/x/one.go", "go"))
    edge = "source string, target string, type string, confidence string"
    ea = spark.createDataFrame([("a", "b", "IMPORTS", "EXACT"), ("b", "c", "CONTAINS", "EXACT"), ("c", "d", "CALLS", "EXACT"), ("c", "gone", "CALLS", "EXACT")], edge)
    eb = spark.createDataFrame([("1", "2", "IMPORTS", "EXACT")], edge)
    left, right = compare.signatures(a, ea, "/repo"), compare.signatures(b, eb, "/repo/")
    assert {(r["kind"], r["sig"]) for r in left.collect()} == {
        ("node", "file:cmd/main.go:main.go"), ("node", "file:pkg/x/one.go:one.go"), ("node", "function:pkg/x/one.go:F"),
        ("edge", "file:cmd/main.go:main.go -> file:pkg/x:x [IMPORTS]"), ("edge", "file:pkg/x/one.go:one.go -> function:pkg/x/one.go:F [CONTAINS]"),
    }
    sides = compare.sides(left, right)
    counts = {r["kind"]: tuple(r)[1:] for r in compare.counts(sides).collect()}
    assert counts == {"node": (3, 3, 2, 1, 1), "edge": (2, 1, 1, 1, 0)}
    assert [r["sig"] for r in compare.examples(sides, "extra", "node", 5).collect()] == ["file:pkg/x/two.go:two.go"]


def test_running_sums(spark):
    from pyspark.sql import functions as F

    rows = [(g, x) for g in ("a", "b", None) for x in range(50)]
    df = spark.createDataFrame(rows, "g string, x int").repartition(7)
    got = {(r["g"], r["x"]): r["s"] for r in ranking.running(df, [F.col("x")], {"s": F.col("x")}, ["g"]).collect()}
    assert got == {(g, x): x * (x + 1) // 2 for g, x in rows}
    assert sorted(r["place"] for r in ranking.numbered(df, [F.col("g"), F.col("x")]).collect()) == list(range(1, 151))
