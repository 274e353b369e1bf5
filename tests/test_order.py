"""One order of edges, through build, Parquet, JSON and traversal."""

import random

from pyspark.sql import functions as F

from cairnspark.operators import build, ranking, traversal
from cairnspark.sinks import graph_store
from cairnspark.sources import files
from cairnspark.staging import staged
from test_build import TREE


def queue(edges, kinds, seed, depth=5):
    """edges in their order: (source, target, type, confidence). What a queue finds: id -> (depth, parent, type of edge, confidence)."""
    back = {}
    for s, t, kind, sure in edges:
        if kind != "IMPORTS" and (kind != "CALLS" or kinds[t] == "function"):
            back.setdefault(t, []).append((s, kind, sure))
    got, line = {seed: (0, None, None, "EXACT")}, [seed]
    for at in line:
        d, _, _, so_far = got[at]
        for s, kind, sure in back.get(at, []) if d < depth else []:
            if s not in got:
                got[s] = (d + 1, at, kind, "HEURISTIC" if "HEURISTIC" in (so_far, sure) else "EXACT")
                line.append(s)
    return got


def found(nodes, edges, seeds):
    rows = traversal.blast_radius(nodes, edges, seeds, paths=False).collect()
    return {r["id"]: (r["depth"], r["parent"], r["parent_edge"], r["confidence"]) for r in rows}


def stored(spark, nodes, edges, tmp_path, name):
    graph_store.save_tables(nodes, edges, str(tmp_path / name))
    graph_store.save_json(nodes, edges, str(tmp_path / f"{name}.json"))
    return graph_store.load_tables(spark, str(tmp_path / name)), graph_store.load_json(spark, str(tmp_path / f"{name}.json"))


def test_random_graphs_before_and_after_a_save(spark, tmp_path):
    """1,000 random multigraphs, side by side in one table, each searched from its own seed by one run."""
    rng = random.Random(6)
    nodes, edges, seeds, want = [], [], [], {}
    for g in range(1000):
        names = [f"g{g:04}n{i}" for i in range(rng.randrange(2, 9))]
        kinds = {x: rng.choice(["function", "function", "class"]) for x in names}
        own = [(rng.choice(names), rng.choice(names), rng.choice(["CALLS", "CALLS", "CONTAINS", "EXTENDS", "IMPORTS"]), rng.choice(["EXACT", "HEURISTIC"])) for _ in range(rng.randrange(16))]
        nodes += [(x, kinds[x], x, False) for x in names]
        edges += own
        seeds.append((names[0], g))
        want |= queue(own, kinds, names[0])
    n = spark.createDataFrame(nodes, "id string, type string, name string, is_test boolean").repartition(3)
    e = spark.createDataFrame([(*x, k) for k, x in enumerate(edges)], "source string, target string, type string, confidence string, edge_ord long").repartition(5)
    s = spark.createDataFrame(seeds, "id string, seed_ord long")
    parquet, doc = stored(spark, n, e, tmp_path, "g")
    for x in (n, e), (parquet.nodes, parquet.edges), (doc.nodes, doc.edges):
        assert found(*x, s) == want


def test_a_graph_without_numbers_keeps_its_answers(spark, tmp_path):
    n = spark.createDataFrame([(x, "function", x, False) for x in "ABSZ"], "id string, type string, name string, is_test boolean")
    e = spark.createDataFrame([("Z", "S", "CALLS", "HEURISTIC"), ("B", "S", "EXTENDS", "EXACT"), ("A", "Z", "CALLS", "EXACT"), ("A", "B", "CALLS", "EXACT")], "source string, target string, type string, confidence string")
    s = spark.createDataFrame([("S",)], "id string")
    one = found(n, e, s)
    parquet, doc = stored(spark, n, e, tmp_path, "h")
    assert one == found(parquet.nodes, parquet.edges, s) == found(doc.nodes, doc.edges, s)


def test_order_of_a_built_graph(spark, tmp_path):
    more = {
        "a.py": "import b\nclass K:\n    def one(self):\n        two()\n        two()\n        three()\n\ndef two():\n    three()\n\ndef three():\n    pass\n",
        "b.py": "class L:\n    def far(self):\n        pass\n",
    }
    for name, text in (TREE | more).items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(text)
    g = build.build(files.parse(files.read_sources(files.walk(spark, str(tmp_path / "t")))))
    name = {r["id"]: r["name"] for r in g.nodes.collect()}
    rows = sorted(g.edges.collect(), key=lambda r: r["edge_ord"])
    assert [r["edge_ord"] for r in rows] == list(range(1, len(rows) + 1))
    kinds = [r["type"] for r in rows]
    assert kinds.index("IMPORTS") > max(i for i, k in enumerate(kinds) if k in ("CONTAINS", "EXTENDS", "IMPLEMENTS"))
    assert kinds.index("CALLS") > max(i for i, k in enumerate(kinds) if k == "IMPORTS")
    own = [(name[r["source"]], name[r["target"]]) for r in rows if r["type"] == "CALLS" and name[r["source"]] in ("one", "two")]
    assert own == [("one", "two"), ("one", "three"), ("two", "three")]
    assert [(name[r["source"]], name[r["target"]]) for r in rows][:5] == [("a.py", "one"), ("a.py", "two"), ("a.py", "three"), ("a.py", "K"), ("b.py", "far")]
    seed = g.nodes.filter("name = 'three'").select("id")
    parquet, doc = stored(spark, g.nodes, g.edges, tmp_path, "b")
    one = found(g.nodes, g.edges, seed)
    assert len(one) > 2 and one == found(parquet.nodes, parquet.edges, seed) == found(doc.nodes, doc.edges, seed)


def test_ranges_of_numbers_are_bounded(spark, monkeypatch):
    """However many rows there are, no task numbers many more than RANGE_ROWS of them."""
    kept = []
    monkeypatch.setattr(ranking, "RANGE_ROWS", 100, raising=False)
    monkeypatch.setattr(ranking, "staged", lambda df, name: kept.append(staged(df, name)) or kept[-1])
    n = spark.range(5000, numPartitions=3).select((F.col("id") * 7919 % 5000).alias("x"))
    got = {r["x"]: r["place"] for r in ranking.numbered(n, [F.col("x")]).collect()}
    assert got == {x: x + 1 for x in range(5000)}
    ranges = kept[-1].groupBy(F.input_file_name()).count()
    assert ranges.agg(F.max("count")).first()[0] <= 300
    assert ranking.numbered(n.limit(0), [F.col("x")]).count() == 0
