from cairnspark.operators import scip_build
from cairnspark.sources import history, scip


def vint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def msg(*pairs):
    out = b""
    for n, v in pairs:
        if isinstance(v, int):
            out += vint(n << 3) + vint(v)
        else:
            v = v.encode() if isinstance(v, str) else bytes(v) if isinstance(v, list) else v
            out += vint(n << 3 | 2) + vint(len(v)) + v
    return out


RUN, HELP, KLASS, METHOD = "scip-go gomod app v1 `app/a`/Run().", "scip-go gomod app v1 `app/b`/help().", "scip-ts npm app v1 b.ts/K#", "scip-ts npm app v1 b.ts/K#draw()."


def index():
    a = msg((1, "a.go"), (4, "go"), (2, msg((1, [0, 5, 8]), (2, RUN), (3, 1), (7, [0, 0, 9, 1]))), (2, msg((1, [4, 2, 6]), (2, HELP))), (2, msg((1, [20, 2, 6]), (2, HELP), (3, 2))))
    b = msg((1, "b.go"), (4, "go"), (2, msg((1, [2, 5, 9]), (2, HELP), (3, 1), (7, [2, 0, 5, 1]))), (2, msg((1, [10, 1, 2]), (2, KLASS), (3, 1), (7, [10, 0, 30, 1]))), (2, msg((1, [12, 1, 2]), (2, METHOD), (3, 1))), (3, msg((1, HELP), (5, 17), (6, "help"))))
    skipped = msg((1, "node_modules/x.js"), (2, msg((1, [1, 1, 2]), (2, "x y z w q()."), (3, 1))))
    return msg((2, a), (2, b), (2, skipped), (3, msg((1, "out"), (5, 7))))


def test_scip_graph(spark):
    docs = scip.decode(spark.createDataFrame([("i", bytearray(index())), ("none", None)], "at string, content binary"))
    assert docs.count() == 4
    nodes, edges = scip_build.build(docs)
    name = {r["id"]: r["name"] for r in nodes.collect()}
    span = {r["name"]: (r["type"], r["start_line"], r["end_line"]) for r in nodes.collect()}
    assert span["Run"] == ("function", 1, 10) and span["help"] == ("function", 3, 6) and span["K"][0] == "class"
    got = {(name[r["source"]], name[r["target"]], r["type"]) for r in edges.collect()}
    assert got == {("Run", "help", "CALLS"), ("a.go", "b.go", "IMPORTS"), ("a.go", "Run", "CONTAINS"), ("b.go", "help", "CONTAINS"), ("b.go", "K", "CONTAINS"), ("b.go", "draw", "CONTAINS"), ("K", "draw", "CONTAINS")}


def test_scip_prefix(spark):
    docs = scip.decode(spark.createDataFrame([("i", bytearray(index()))], "at string, content binary"))
    assert "sub/a.go" in {r[0] for r in scip.prefixed(docs, "sub").select("relative_path").collect()}


def test_history(spark):
    log = spark.createDataFrame([("a1\x1fp\x1f100\x1fFix crash",), ("\nb2\x1f\x1f90\x1froot",), ("\nc3\x1fp q\x1f80\x1fprefix",), ("",)], "value string")
    assert [(r.sha, r.fix) for r in history.commits(log).orderBy("sha").collect()] == [("a1", True), ("c3", False)]
    stat = spark.createDataFrame([("a1", "3\t2\tx.go\n-\t-\tp.png\n")], "sha string, value string")
    assert [tuple(r) for r in history.churn(stat).collect()] == [("a1", 5, 2)]


def test_owners(spark):
    rules = history.owner_rules("# c\n*.go @go\n/internal/ @core @alice\nlonely\n")
    paths = spark.createDataFrame([("x/a.go",), ("internal/b.go",), ("c.js",), ("x/internal/d.js",)], "path string")
    assert {r.path: r.owners for r in history.owners(paths, rules).collect()} == {"x/a.go": ["@go"], "internal/b.go": ["@core", "@alice"], "c.js": None, "x/internal/d.js": None}
    assert [tuple(r) for r in history.reviewers(paths, rules).collect()] == [("@alice", 1), ("@core", 1), ("@go", 1)]


def test_scip_with_sources(spark):
    """Members that can't be called fall out, ends widen to the parsed ones, a call into another package imports its first file."""
    run, field, method, there = "scip-go gomod app v1 `app`/Run().", "scip-go gomod app v1 `app`/T#field.", "scip-go gomod app v1 `app`/T#meth.", "scip-go gomod lib v1 `lib`/f()."
    occurrence = lambda line, symbol, roles=0: {"range": [line, 5, 8], "symbol": symbol, "roles": roles, "enclosing": []}
    a = [occurrence(0, run, 1), occurrence(3, there), occurrence(8, field, 1), occurrence(9, method, 1)]
    rows = [("i", 0, "a.go", "go", a, []), ("i", 1, "lib/b.go", "go", [occurrence(1, there, 1)], []), ("i", 2, "lib/a.go", "go", [occurrence(1, there.replace("f()", "g()"), 1)], [])]
    docs = spark.createDataFrame(rows, scip.SCHEMA)
    lines = scip.source_lines(spark.createDataFrame([("a.go", b"func Run() {\n\n\n  f()\n\n}\n\n\nfield int\nfunc (t T) meth() {}")], "file_path string, content binary"))
    parsed = spark.createDataFrame([("a.go", "go", [("Run", 1, 6)])], "file_path string, language string, functions array<struct<name:string,start_line:bigint,end_line:bigint>>")
    nodes, edges = scip_build.build(docs, lines, parsed)
    span = {r["name"]: (r["start_line"], r["end_line"]) for r in nodes.filter("type = 'function'").collect()}
    assert span == {"Run": (1, 6), "meth": (10, 10), "f": (2, 2), "g": (2, 2)}
    name = {r["id"]: r["file_path"] if r["type"] == "file" else r["name"] for r in nodes.collect()}
    got = {(name[r["source"]], name[r["target"]], r["type"]) for r in edges.filter("type != 'CONTAINS'").collect()}
    first = min(("lib/a.go", "lib/b.go"), key=lambda p: {v: k for k, v in name.items()}[p])
    assert got == {("Run", "f", "CALLS"), ("a.go", first, "IMPORTS")}
    assert {tuple(r) for r in scip.definitions_per_document(docs).collect()} == {("a.go", 3), ("lib/b.go", 1), ("lib/a.go", 1)}
    assert {r["type"]: r["n"] for r in scip_build.edge_counts(edges).collect()}["CONTAINS"] == 4
