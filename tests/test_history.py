import json
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnspark import cli
from cairnspark.functions import paths, text
from cairnspark.operators import evaluation, replay, resolution
from cairnspark.sources import files, git, history, scip_index
from cairnspark.sources import scip as S


def test_generator_steps():
    """Against the recurrence in Python integers."""
    for seed in (0, 1, 19):
        x, want = (seed * 2862933555777941757 + 3037000493) % 2**64, []
        for _ in range(300):
            x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
            want.append(x >> 11)
        assert evaluation.step_scores(np.arange(300), seed).tolist() == want


def test_metrics_by_hand(spark):
    rows = [("a", 0, 9.0, 0), ("a", 1, 9.0, 1), ("a", 2, 3.0, 1), ("a", 3, 1.0, 0), ("b", 0, 1.0, 0), ("b", 1, 2.0, 0)]
    got = {r["ranker"]: (r["auc"], r["p_at_1"], r["p_at_3"], r["ifa"]) for r in evaluation.metrics(spark.createDataFrame(rows, "ranker string, place long, score double, label int"), [1, 3], "place", ["ranker"]).collect()}
    assert got == {"a": (0.625, 0.0, 0.666667, 2), "b": (0.5, 0.0, 0.0, 3)}


def test_hot_fixes_by_all_pairs(spark):
    import random

    random.seed(5)
    rows = [(f"c{i}", random.randrange(400), random.choice("fgh"), random.random() < 0.2) for i in range(150)]
    window = 30
    want = {a[0] for a in rows for b in rows if b[3] and a[2] == b[2] and a[1] < b[1] <= a[1] + window}
    got = {r["sha"] for r in evaluation.hot_fixed(spark.createDataFrame(rows, "sha string, t long, file string, fix boolean"), window).collect()}
    assert got == want


def test_scopes_by_all_pairs(spark):
    import random

    random.seed(9)
    scopes = [(f"s{i}", random.choice("ab"), a, a + random.choice([0, 0, 3, 40, 500])) for i in range(60) for a in [random.randrange(900)]]
    refs = [(i, random.choice("abc"), random.randrange(1000), f"s{random.randrange(60)}") for i in range(200)]
    want = {}
    for ref, f, line, target in refs:
        held = [(-a, b, i) for i, g, a, b in scopes if g == f and i != target and a <= line and (a == b or line <= b)]
        if held:
            want[ref] = min(held)[2]
    got = resolution.scope_of(spark.createDataFrame(refs, "ref int, file_path string, line int, target string"), spark.createDataFrame(scopes, "id string, file_path string, start_line int, end_line int"))
    assert {r["ref"]: r["scope"] for r in got.collect()} == want


def test_base_classes_by_hand(spark):
    classes = [("1", "A", "f", "p"), ("2", "A", "g", "p"), ("3", "B", "f", "p"), ("4", "B", "f", "q"), ("5", "C", "h", "q"), ("6", "D", "f", None)]
    uses = [("3", "A", "f", "p"), ("5", "A", "h", "p"), ("4", "C", "f", "q"), ("1", "B", "f", "p"), ("1", "A", "f", "p"), ("6", "C", "f", None), ("6", "D", "f", None)]
    got = resolution.base_classes(spark.createDataFrame(uses, "child string, base string, file_path string, package string"), spark.createDataFrame(classes, "id string, name string, file_path string, package string"))
    found = {(r["child"], r["base"]): (r["tier"], r["id"], r["status"]) for r in got.collect()}
    assert found == {("3", "A"): (1, "1", "EXACT"), ("5", "A"): (2, None, "AMBIGUOUS"), ("4", "C"): (2, "5", "EXACT"), ("1", "B"): (1, None, "AMBIGUOUS"), ("1", "A"): (2, "2", "EXACT"), ("6", "C"): (3, "5", "HEURISTIC")}


def test_texts(spark):
    now = 10_000_000_000
    ago = [0, 30, 60, 119, 3600, 7200, 86_400, 86_400 * 29, 86_400 * 30, 86_400 * 364, 86_400 * 365, 86_400 * 800]
    df = spark.createDataFrame([(now - a,) for a in ago] + [(0,), (None,)], "t long")
    got = [r[0] for r in df.select(text.relative_time(F.col("t"), F.lit(now))).collect()]
    assert got == ["just now", "just now", "1 minute ago", "1 minute ago", "1 hour ago", "2 hours ago", "1 day ago", "29 days ago", "1 month ago", "12 months ago", "1 year ago", "2 years ago", "unknown", "unknown"]
    df = spark.createDataFrame([("internal/graph/x/a.go",), ("web/src/lib/deep/a.ts",), ("docs/a.md",), ("a.go",)], "p string")
    assert [r[0] for r in df.select(text.package_path(F.col("p"))).collect()] == ["internal/graph", "src/lib", "docs", "root"]
    df = spark.createDataFrame([("a/b/c", "go"), ("../../x/y.ts", "typescript"), ("./z", "javascript"), ("..pkg.mod", "python"), ("...", "python"), ("q", "rust")], "p string, l string")
    assert [r[0] for r in df.select(text.import_name(F.col("p"), F.col("l"))).collect()] == ["c", "y", "z", "mod", "", ""]
    assert (text.truncate("abcdefgh", 6), text.truncate("abc", 3), text.truncate("abcd", 2)) == ("abc...", "abc", "ab")
    assert text.globs(" a/**, ,b ") == ["a/**", "b"] and text.languages("JS, golang,x") == ["go", "javascript", "x"] and text.languages("") is None
    assert (text.percent(1, 4), text.percent(1, 0), text.plural(1, "call"), text.plural(2, "call")) == (25.0, 0.0, "1 call", "2 calls")
    assert (text.owner_repo("h.com/o/r"), text.tail_path("a/b/c/d"), text.short_path("/a/b/c", "/a")) == ("o/r", ".../c/d", "b/c")


@pytest.mark.parametrize("glob, path, want", [("src/[A-C]*.go", "src/B.go", 1), ("src/[!A-C]*.go", "src/B.go", 0), ("{a,{b,c}d}/*.js", "cd/x.js", 1), ("{a,{b,c}d}/*.js", "c/x.js", 0), ("a[/]b", "a/b", 1), ("x{", "x{", 1), ("\\*", "*", 1), ("\\*", "a", 0), ("[^a]", "/", 0)])
def test_globs(glob, path, want):
    import re

    assert bool(re.search(paths.glob_regex(glob, False), path)) == bool(want)


def test_walk(spark, tmp_path):
    for name in ("a.go", "pkg/__init__.py", "pkg/b c.py", "node_modules/c.js", "pkg/.git/d.go", ".github/e.ts", "f.min.js", "g.txt", "pkg/vendor/h.go"):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text("x")
    (tmp_path / "tree" / "loop").symlink_to(tmp_path / "tree")
    want = {"a.go": "go", "pkg/b c.py": "python", "pkg/__init__.py": "python", ".github/e.ts": "typescript"}
    for root in (str(tmp_path / "tree"), f"file://{tmp_path}/tree"):
        assert {r["file_path"]: r["language"] for r in files.walk(spark, root).collect()} == want
        assert {r["file_path"]: r["content"] for r in files.read_sources(files.walk(spark, root)).collect()} == dict.fromkeys(want, b"x")
    (tmp_path / "vendor").mkdir()
    (tmp_path / "vendor" / "a.go").write_text("x")
    (tmp_path / "empty").mkdir()
    assert files.walk(spark, str(tmp_path / "vendor")).count() == files.walk(spark, str(tmp_path / "empty")).count() == 0


def test_parse_limits_and_cache(spark, tmp_path, monkeypatch):
    import time

    with pytest.raises(TimeoutError), files.at_most(0.05):
        time.sleep(2)
    assert files.load_cache(spark, str(tmp_path / "none")).count() == 0
    parsed = files.parse(spark.createDataFrame([("a.py", "python", b"class A:\n    def f(self): pass\n")], "file_path string, language string, content binary"))
    files.save_cache(parsed, str(tmp_path / "cache"))
    assert files.load_cache(spark, str(tmp_path / "cache")).count() == 1
    bad = parsed.withColumn("language", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        files.save_cache(bad, str(tmp_path / "cache"))
    assert files.load_cache(spark, str(tmp_path / "cache")).count() == 1  # a failed write leaves what was there
    files.save_cache(parsed.unionByName(parsed), str(tmp_path / "cache"))
    assert files.load_cache(spark, str(tmp_path / "cache")).count() == 2
    from cairnspark.operators import build

    assert [tuple(r) for r in build.file_metadata(parsed).select("file_path", "language", "node_count").collect()] == [("a.py", "python", 2)]


def test_scip_helpers(spark, tmp_path):
    assert [S.source_root(x) for x in ("/r/index.scip", "/r/.cairnspark/scip/scip-go.scip", "index.scip")] == ["/r", "/r", "."]
    lines = S.source_lines(spark.createDataFrame([("./a.go", b"one\ntwo"), ("a.go", b"zzz")], "file_path string, content binary"))
    assert [tuple(r) for r in lines.orderBy("line").collect()] == [("a.go", 1, "one"), ("a.go", 2, "two")]
    root, out = tmp_path / "r", str(tmp_path / "out")
    (root / "web").mkdir(parents=True)
    for name in ("go.mod", "m.go", "web/package.json", "web/x.ts"):
        (root / name).write_text("x")
    listed = {"go": [str(root / "m.go")], "typescript": [str(root / "web" / "x.ts")]}
    ran = []

    def run(args, folder):
        ran.append(args[0])
        if args[0] == "scip-go":
            (root / "index.scip").write_bytes(b"")

    hooks = scip_index.Hooks(which=lambda c: c, run=run)
    found, states = scip_index.collect(str(root), out, listed, hooks)
    assert [(s.name, s.state) for s in states] == [("scip-go", "generated"), ("scip-typescript@web", "failed"), ("scip-python", "skipped")] and len(found) == 1
    found, states = scip_index.collect(str(root), out, listed, scip_index.Hooks(which=lambda c: None))
    assert [s.state for s in states] == ["cached", "missing_binary", "skipped"] and scip_index.status_table(spark, states).count() == 3
    (root / "index.scip").write_bytes(b"")
    assert scip_index.collect(str(root), out, listed)[1][0].state == "used_existing"


def test_last_authors(spark):
    log = spark.createDataFrame([("f", " A ", "a@x", 5), ("f", "B", "b@x", 9), ("g", "A", "a@x", 1)], "path string, author string, email string, unix_time long")
    rows = spark.createDataFrame([("f",), ("h",)], "file_path string")
    assert {r["file_path"]: (r["last_author"], r["last_modified"]) for r in history.with_authors(rows, history.last_authors(log)).collect()} == {"f": ("B", 9), "h": (None, None)}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    """Four commits: functions, a change, a fix of it, a revert of the fix."""
    root = tmp_path_factory.mktemp("repo")
    clock = iter(range(1_700_000_000, 1_700_000_000 + 86_400 * 30, 3600))

    def call(*args):
        when = str(next(clock))
        env = {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "HOME": str(root), "PATH": "/usr/bin:/bin:/usr/local/bin", "GIT_CONFIG_NOSYSTEM": "1"}
        return subprocess.run(["git", "-C", str(root), "-c", "user.name=N", "-c", "user.email=n@x", *args], check=True, capture_output=True, text=True, env=env).stdout.strip()

    def write(body):
        (root / "core.py").write_text(f"def low():\n    return {body}\n\n\ndef mid():\n    return low()\n\n\ndef top():\n    return mid()\n")
        call("add", "-A")

    call("init", "-q")
    write(0)
    call("commit", "-qm", "start")
    write(1)
    call("commit", "-qm", "change low")
    write(2)
    call("commit", "-qm", "fix low")
    call("revert", "--no-edit", "HEAD")
    return root


def test_history_of_a_repository(spark, repo):
    run = git.runner(str(repo))
    report = replay.evaluate(spark, run, most=10, window_days=1, seeds=3)
    rows = {r["subject"]: r for r in report.commits.collect()}
    assert set(rows) == {"change low", "fix low", 'Revert "fix low"'}  # the first commit has no parent
    assert {k: (r["hot_fixed"], r["reverted"], r["label"]) for k, r in rows.items()} == {"change low": (True, False, 1), "fix low": (True, True, 1), 'Revert "fix low"': (False, False, 0)}
    assert {k: (r["churn"], r["changed"], r["affected"]) for k, r in rows.items()} == {k: (2, 1, 2) for k in rows}
    assert tuple(report.counts.first()) == (3, 2, 1, 2)
    rankers = {r["ranker"]: r for r in report.rankers.collect()}
    assert rankers["ladder"]["auc"] == rankers["churn"]["auc"] == 0.5 and rankers["churn"]["ifa"] == 2 and set(rankers) == {"ladder", "churn", "random"}


def test_commands(spark, repo, capsys, tmp_path):
    from cairnspark.server import Service

    call = lambda *a: cli.main(["--root", str(repo), *a], spark)
    assert call("index") == 0 and "node:function" in capsys.readouterr().out
    diff = tmp_path / "d.diff"
    diff.write_text("--- a/core.py\n+++ b/core.py\n@@ -1,2 +1,2 @@\n def low():\n-    return 1\n+    return 9\n")
    assert call("analyze", "--diff", str(diff), "--format", "json", "--owners") == 2
    out = json.loads(capsys.readouterr().out)
    assert [(r["name"], r["depth"], r["path"][-1] == r["id"], r["last_author"]) for r in out["affected"]] == [("mid", 1, True, "N"), ("top", 2, True, "N")]
    assert call("analyze", "--diff", str(diff), "--top", "1") == 2 and "affected functions: 2" in capsys.readouterr().out
    assert call("why", "top", "low") == 0 and "2 calls" in capsys.readouterr().out
    assert call("why", "o", "low") == 3 and "ambiguous" in capsys.readouterr().err
    assert call("hotspots", "--lang", "py") == 0 and "mid" in capsys.readouterr().out
    assert call("report", "--diff", str(diff), "--out", str(tmp_path / "r.html")) == 0 and "Most called" in (tmp_path / "r.html").read_text()
    assert call("eval", "--max", "5", "--seeds", "2") == 0 and "ladder" in capsys.readouterr().out
    service = Service(spark, str(repo / ".cairnspark" / "graph.json"), git.runner(str(repo)))
    status, stats = service.answer("GET", "/api/stats")
    assert status == 200 and stats["node_types"]["function"] == 3 and stats["languages"] == {"python": 4}
    assert service.answer("GET", "/api/repo")[1]["commit"] == git.head(git.runner(str(repo)))
    assert len(service.answer("GET", "/api/graph")[1]["nodes"]) == 4
    assert service.answer("GET", "/api/hotspots?top=1")[1]["hotspots"][0]["name"] == "mid"
    assert service.answer("POST", "/api/analyze", "")[0] == 400 and service.answer("GET", "/nothing")[0] == 404
    assert [r["name"] for r in service.answer("POST", "/api/analyze?depth=1", diff.read_text())[1]["affected"]] == ["mid"]
    assert service.answer("GET", "/api/analyze/diff")[0] == 404
    (repo / "core.py").write_text((repo / "core.py").read_text().replace("return low()", "return low() + 1"))
    assert [r["name"] for r in service.answer("GET", "/api/analyze/diff")[1]["affected"]] == ["top"]
    assert service.answer("POST", "/api/reload")[1] == {"status": "reloaded", "nodes": 4, "edges": 5}
