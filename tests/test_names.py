"""Many names through the index, against one scan a name."""

import random

import pytest
from oracle import assert_matches

from cairnspark.operators import search
from cairnspark.plans import registry

NODE = "id string, type string, name string, package string, asked int"


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abAB.Σİé") for _ in range(r.randint(0, 5)))
    rows = [(f"f{i:03}", "function" if i % 9 else "class", word(), r.choice(["", "a", "b/a", None, "a.b"]), i) for i in range(300)]
    rows += [("f900", "function", None, "a", 0), ("f901", "function", "Build", "internal/graph", 0), ("f901", "function", "Build", "graph", 0), ("f902", "function", "x y", "p", 0)]
    return spark.createDataFrame(rows, NODE), sorted({word() for _ in range(25)} | {"graph.Build", "raph.Build", "build", " Build ", "", "  ", "a.", ".a", "a", "ab", "AΣ", "İ", "i", "x y", "zz", "b/a.ab"})


def test_each_name_as_by_itself(spark, graph):
    nodes, names = graph
    asked = spark.createDataFrame([(x,) for x in [*names, *names, None]], "asked string")
    found = search.name_searches(search.name_index(nodes), asked).cache()
    got = {tuple(x) for x in found.collect()}
    assert len(got) == found.count()
    functions = [(x.id, x.name, x.package or "") for x in nodes.filter("type = 'function' AND name IS NOT NULL").collect()]
    lower = {x.t: x.l for x in spark.createDataFrame([(x,) for x in {n.strip() for n in names} | {f[1] for f in functions}], "t string").selectExpr("t", "lower(t) AS l").collect()}
    want = set()
    for q in {x.strip() for x in names} - {""}:
        owner, _, last = q.rpartition(".")
        for i, name, package in functions:
            if name == q:
                tier = 0
            elif owner and name == last and (package == owner or package.endswith("/" + owner)):
                tier = 1
            elif name.startswith(q):
                tier = 2
            elif lower[q] in lower[name]:
                tier = 3
            else:
                continue
            want.add((q, i, name, search.TIERS[tier], f"{package}.{name}", tier))
    assert got == want and {x[5] for x in want} == {0, 1, 2, 3}

    one = {x.asked: (x.id, x.matches, x.candidates) for x in search.unique_names(asked, found).collect()}
    assert set(one) == {x.strip() for x in names}
    for q, (i, matches, candidates) in one.items():
        hits = sorted((x[5], x[1]) for x in want if x[0] == q)
        best = [x for x in hits if x[0] == hits[0][0]] if hits else []
        only = best[0][1] if len(hits) == 1 or (len(best) == 1 and best[0][0] <= 1) else None
        assert (i, matches) == (only, len(hits))
        assert candidates == ([] if only else [x[1] for x in hits[: search.SHOWN]])
    for q in ("graph.Build", "build", "a"):
        assert {(x.id, x.tier) for x in search.name_search(nodes, q).collect()} == {(x[1], x[5]) for x in want if x[0] == q}


def test_empty(spark, graph):
    nodes, _ = graph
    none = spark.createDataFrame([], "asked string")
    assert search.name_searches(search.name_index(nodes), none).collect() == []
    some = spark.createDataFrame([("a",), (" ",)], "asked string")
    found = search.name_searches(search.name_index(nodes.limit(0)), some)
    assert {tuple(x[:3]) for x in search.unique_names(some, found).collect()} == {("a", None, 0), ("", None, 0)}


@pytest.mark.parametrize("name", ["names_searched", "names_resolved"])
def test_queries(spark, sf, name):
    assert assert_matches(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf) > 100


def test_a_name_that_many_functions_have_is_one(spark):
    rows = [(f"f{i:05}", "function", ["Build", "build x"][i % 2], "ab"[i % 3 > 0], 0) for i in range(3000)]
    index = search.name_index(spark.createDataFrame(rows, NODE))
    assert index.postings.count() < 100
    asked = spark.createDataFrame([(x,) for x in ["Build", "b.Build", "uild", "x", "f", "", None]], "asked string")
    want = {tuple(map(str, x)) for x in search.unique_names(asked, search.name_searches(index, asked)).collect()}
    assert {tuple(map(str, x)) for x in search.resolved_names(index, asked).collect()} == want


def test_counts_by_kind_equal_the_rows(spark, graph):
    nodes, names = graph
    index, asked = search.name_index(nodes), spark.createDataFrame([(x,) for x in names], "asked string")
    want = {tuple(map(str, x)) for x in search.unique_names(asked, search.name_searches(index, asked)).collect()}
    assert {tuple(map(str, x)) for x in search.resolved_names(index, asked).collect()} == want
