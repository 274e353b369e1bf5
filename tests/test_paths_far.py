"""Shortest paths from both ends, against a plain queue."""

import random
from collections import deque

import pytest
from oracle import assert_matches

from cairnspark.operators import traversal
from cairnspark.plans import registry

EDGE = "source string, target string, type string, confidence string, edge_ord long"


def queue_path(edges, source, target):
    """The path that a queue finds first; edges in their order."""
    parent, queue = {source: None}, deque([source])
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    while queue:
        now = queue.popleft()
        if now == target:
            path = [now]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            return path[::-1]
        for b in out.get(now, []):
            if b not in parent:
                parent[b] = now
                queue.append(b)
    return None


def layered(seed, depth=20, wide=3):
    """Layers with many ways of equal length, calls back, and repeated calls."""
    r = random.Random(seed)
    name = lambda d, i: f"f{d}_{i}"
    edges = [(name(d, r.randrange(wide)), name(d + 1, r.randrange(wide))) for d in range(depth) for _ in range(2 * wide)]
    edges += [(name(r.randrange(depth), r.randrange(wide)), name(r.randrange(depth // 2), r.randrange(wide))) for _ in range(10)]
    r.shuffle(edges)
    return edges, [name(0, i) for i in range(wide)], [name(depth, i) for i in range(wide)]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("reverse", [False, True])
def test_deep_paths_are_those_of_a_queue(spark, seed, reverse):
    edges, starts, ends = layered(seed)
    df = spark.createDataFrame([(*((b, a) if reverse else (a, b)), "CALLS", "EXACT", k) for k, (a, b) in enumerate(edges)], EDGE)
    source, target = next((a, b) for a in starts for b in ends if queue_path(edges, a, b))
    got = traversal.shortest_path(df, source, target, reverse)
    assert got == queue_path(edges, source, target) and len(got) == 21


@pytest.mark.parametrize("seed", range(6))
def test_random_graphs(spark, seed):
    r = random.Random(100 + seed)
    names = [f"n{i}" for i in range(12)]
    edges = [(r.choice(names), r.choice(names)) for _ in range(18)]
    df = spark.createDataFrame([(a, b, "CALLS", "EXACT", k) for k, (a, b) in enumerate(edges)] + [("n0", None, "CALLS", "EXACT", 99), ("n0", "n1", "IMPORTS", "EXACT", 100)], EDGE)
    source, target = r.sample(names, 2)
    assert traversal.shortest_path(df, source, target) == queue_path(edges, source, target)


def test_far_query(spark):
    sf = "/root/testdata/sf0.001"
    assert assert_matches(registry.QUERIES["shortest_path_far"](spark, sf), registry.ORACLE_SQL["shortest_path_far"], sf) >= 6
