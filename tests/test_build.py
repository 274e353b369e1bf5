import pytest

from cairnspark.operators import build
from cairnspark.sources import files, parsers

TREE = {
    "main.go": 'package main\nimport (\n  "fmt"\n  m "ex.com/app/models"\n)\nfunc main() {\n  u := &User{}\n  m.Load("x")\n  helper()\n  fmt.Println(1)\n}\nfunc helper() int { return 1 }\n',
    "models/user.go": "package models\ntype Base struct {\n  n int\n}\ntype User struct {\n  Base\n}\nfunc Load(s string) *User { return nil }\nfunc (u *User) Save() { u.check() }\nfunc (u *User) check() {}\n",
    "models/user_test.go": "package models\nfunc TestLoad() { Load(\"a\") }\n",
    "web/a.ts": "import { run as go } from './b';\nexport class A extends Base implements Shape { draw(): void { go(); } }\ninterface Shape { draw(): void }\n",
    "web/b.ts": "export function run() { missing(); }\nexport class Base {}\n",
    "py/pkg/__init__.py": "def start():\n    pass\n",
    "py/use.py": "from pkg import start\nclass K:\n    def go(self):\n        return start()\n",
    "py/bad.py": "def (:\n",
    "node_modules/x.js": "function no() {}\n",
    "web/z.min.js": "function no() {}\n",
}


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return files.parse(files.read_sources(files.walk(spark, str(root)))).cache()


def test_graph_of_a_tree(spark, parsed):
    assert {r["file_path"] for r in parsed.collect()} == set(TREE) - {"node_modules/x.js", "web/z.min.js"}
    assert [r["file_path"] for r in parsed.filter("error IS NOT NULL").collect()] == ["py/bad.py"]
    g = build.build(parsed)
    names = {r["id"]: (r["name"] if r["type"] != "file" else r["file_path"]) for r in g.nodes.collect()}
    edges = {(names[r["source"]], names[r["target"]], r["type"], r["confidence"]) for r in g.edges.collect()}
    for want in [
        ("main", "Load", "CALLS", "EXACT"),
        ("main", "helper", "CALLS", "EXACT"),
        ("TestLoad", "Load", "CALLS", "EXACT"),
        ("Save", "check", "CALLS", "EXACT"),
        ("draw", "run", "CALLS", "EXACT"),
        ("go", "start", "CALLS", "HEURISTIC"),
        ("main.go", "models/user.go", "IMPORTS", "EXACT"),
        ("web/a.ts", "web/b.ts", "IMPORTS", "EXACT"),
        ("py/use.py", "py/pkg/__init__.py", "IMPORTS", "EXACT"),
        ("User", "Base", "EXTENDS", "EXACT"),
        ("A", "Shape", "IMPLEMENTS", "EXACT"),
        ("User", "Save", "CONTAINS", "EXACT"),
        ("models/user.go", "User", "CONTAINS", "EXACT"),
    ]:
        assert want in edges, (want, sorted(edges))
    status = {(r["name"], r["status"]) for r in g.sites.collect()}
    assert ("missing", "UNRESOLVED") in status and ("Println", "UNRESOLVED") in status


def test_cache_splits_by_hash(spark, parsed):
    src = spark.createDataFrame([("a.py", "python", b"x()"), ("main.go", "go", TREE["main.go"].encode())], "file_path string, language string, content binary")
    fresh, kept = files.split_cached(src, parsed)
    assert [r["file_path"] for r in fresh.collect()] == ["a.py"]
    assert [r["file_path"] for r in kept.collect()] == ["main.go"]


def test_empty_tables_and_nulls(spark):
    src = spark.createDataFrame([("a.py", "python", None), ("b.rs", "rust", b"fn x() {}")], "file_path string, language string, content binary")
    g = build.build(files.parse(src))
    assert g.nodes.count() == 2 and g.edges.count() == 0
    assert build.build(files.parse(src.limit(0))).edges.count() == 0


def test_python_calls_and_decorators():
    got = parsers.parse_python("@a.b\ndef f():\n    x.y.z(1)\n    g()(2)\n")
    assert got["functions"][0]["decorators"] == ["a.b"]
    assert ("z", "x.y") in {(c["name"], c["receiver"]) for c in got["calls"]}
