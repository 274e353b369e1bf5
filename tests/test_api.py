import json

import pytest

from cairnspark import api
from cairnspark.sinks import graph_store, reports
from cairnspark.streaming import history

TREE = {"core/a.py": "def low():\n    return 1\n\ndef mid():\n    return low()\n", "core/b.py": "def top():\n    return mid()\n"}
DIFF = "--- a/core/a.py\n+++ b/core/a.py\n@@ -1,2 +1,2 @@\n def low():\n-    return 0\n+    return 1\n"


def test_index_analyze_report(spark, tmp_path):
    for name, text in TREE.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_text(text)
    g, parsed = api.index(spark, str(tmp_path / "src"))
    graph_store.save_json(g.nodes, g.edges, str(tmp_path / "g.json"), commit="abc", remote="git@h.com:o/r.git")
    assert json.loads((tmp_path / "g.json").read_text())["repo_remote"] == "h.com/o/r"
    stored = graph_store.load_json(spark, str(tmp_path / "g.json"))
    assert stored.commit == "abc" and stored.nodes.count() == 5
    with pytest.raises(graph_store.StaleGraph):
        graph_store.require_fresh(stored, "def")
    hit = api.analyze(spark, stored.nodes, stored.edges, DIFF)
    rows = [r.asDict() for r in hit.affected.select("name", "score", "risk", "callers", "depth", "confidence").collect()]
    assert [(r["name"], r["depth"]) for r in rows] == [("mid", 1), ("top", 2)] and hit.code == 2
    md = reports.markdown(rows, {"affected": 2}, [{"owner": "@a", "files": 1}], total=3)
    assert "| mid |" in md and "2 of 3" in md and "@a" in md
    assert "MEDIUM (2)" in reports.text(rows, {"affected": 2})
    assert "</script><" not in reports.page([{"name": "</script><b>"}], {}).split("<script", 1)[1][:-20]
    assert json.loads(reports.as_json(rows, {"n": 2}))["affected"][0]["name"] == "mid"
    with pytest.raises(ValueError):
        api.analyze(spark, stored.nodes, stored.edges, DIFF, api.Settings(ignore=["core/**"]))


def test_comments_and_diagnostics():
    body, old = reports.comment("text", [{"id": 4, "body": "other"}, {"id": 7, "body": reports.MARK + " before"}])
    assert old == 7 and reports.MARK in body and reports.comment("x", [])[1] is None
    issues = [{"file": f"f{i}", "problem": "p"} for i in range(13)]
    assert "and 3 more" in reports.text([], {}, issues) and "file: f9" in reports.markdown([], {}, issues=issues)


def test_configuration_is_searched_upwards(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert api.Settings.find(str(tmp_path / "a" / "b")) == (api.Settings(), [])
    (tmp_path / ".cairnspark.yaml").write_text("max_depth: 3\ntop: -1\nignore: ['x/**']\nrisk: {high_callers: 4}\n")
    s, warnings = api.Settings.find(str(tmp_path / "a" / "b"))
    assert (s.max_depth, s.top, s.ignore, s.risk.high) == (3, 0, ["x/**"], 4) and len(warnings) == 1
    (tmp_path / "a" / ".cairnspark.yml").write_text("{")
    assert api.Settings.find(str(tmp_path / "a" / "b"))[0] == api.Settings() and api.Settings.find(str(tmp_path / "a"))[1]


def test_settings():
    s, warnings = api.Settings.of({"max_depth": -1, "top": 3, "risk": {"high_callers": 7, "medium_callers": 0}})
    assert (s.max_depth, s.top, s.risk.high, s.risk.medium) == (5, 3, 7, 3) and len(warnings) == 2


def test_streams(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", "f"), ("b", "2024-01-01 05:00:00", "f"), ("c", "2024-01-02 00:00:00", "f"), ("d", "2024-01-01 01:00:00", "g")]
    spark.createDataFrame(rows, "sha string, t string, file string").selectExpr("sha", "to_timestamp(t) AS ts", "file", "1.5D AS churn").write.parquet(str(tmp_path / "c"))
    read = lambda: spark.readStream.schema("sha string, ts timestamp, file string, churn double").parquet(str(tmp_path / "c"))
    pairs = history.fixed_later(read(), read().filter("sha != 'a'"), "6 HOURS")
    q = pairs.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert [(r.sha, r.fix_sha) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [("a", "b")]
    src = spark.createDataFrame([("a.py", "python", b"def f(): pass")], "file_path string, language string, content binary")
    src.write.parquet(str(tmp_path / "s"))
    history.index_stream(spark.readStream.schema(src.schema).parquet(str(tmp_path / "s")), str(tmp_path / "p"), str(tmp_path / "k2")).awaitTermination(90)
    assert spark.read.parquet(str(tmp_path / "p")).selectExpr("functions[0].name").first()[0] == "f"
