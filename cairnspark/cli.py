"""The commands: index, analyze, why, hotspots, report, serve, validate-scip, eval. Exit codes: 0 fine, 1 something HIGH, 2 something MEDIUM, 3 an error."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cairnspark import api
from cairnspark.functions import paths as P
from cairnspark.functions import text as T
from cairnspark.operators import analysis, build, replay
from cairnspark.sinks import graph_store, reports
from cairnspark.sources import files, git, history, scip_index


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _listed(spark, root: str) -> dict[str, list[str]]:
    """Source files by language, for the indexers."""
    listed: dict[str, list[str]] = {}
    for r in files.walk(spark, root).collect():
        listed.setdefault(r["language"], []).append(r["at"])
    return listed


def _index(spark, a, s) -> int:
    out = os.path.join(a.root, ".cairnspark")
    cache, run = os.path.join(out, "parsed.parquet"), git.runner(a.root)
    os.makedirs(out, exist_ok=True)
    if a.scip:
        found, states = scip_index.collect(a.root, out, _listed(spark, a.root))
        print(reports.statuses([vars(x) for x in states]), end="")
        if not found:
            raise ValueError("no SCIP index")
        nodes, edges = api.index_scip(spark, found, a.root)
    else:
        graph, parsed = api.index(spark, a.root, files.load_cache(spark, cache))
        files.save_cache(parsed, cache)
        nodes, edges = graph.nodes, graph.edges
        print(reports.resolution(build.resolution_stats(graph.sites).first().asDict()), end="")
    graph_store.save_json(nodes, edges, os.path.join(a.root, s.graph_path), git.head(run), git.remote(run), a.root)
    print(reports.counts({r["key"]: r["n"] for r in api.stats(nodes, edges).collect()}), end="")
    return 0


def _stored(spark, a, s) -> graph_store.Stored:
    return graph_store.load_json(spark, os.path.join(a.root, s.graph_path))


def _analyze(spark, a, s) -> int:
    g, run = _stored(spark, a, s), git.runner(a.root)
    graph_store.require_fresh(g, git.head(run), a.allow_stale)
    diff = api.read_diff(a.diff)
    if not diff.strip():
        raise ValueError("no diff: name a file or pipe one in")
    s.ignore += T.globs(a.ignore or "")
    s.top = a.top if a.top is not None else s.top
    s.max_depth = a.depth or s.max_depth
    impact = api.analyze(spark, g.nodes, g.edges, diff, s)
    authors = history.last_authors(git.author_log(spark, run)) if a.owners else None
    rules = history.owner_rules(history.owner_file(a.root)) if a.owners else []
    rows, reviewers = api.owned(impact, g.nodes, authors, rules)
    listed, who = _rows(analysis.ranked(rows)), _rows(reviewers)
    summary = {"changed files": impact.changed.count(), "affected functions": impact.total or len(listed), "exit code": impact.code}
    form = a.format or s.format
    issues = [{"file": r["path"], "problem": "no node of the graph"} for r in _rows(impact.changed.join(g.nodes.select(F.col("file_path").alias("path")), "path", "left_anti").select("path"))]
    if form == "json":
        print(reports.as_json(listed, summary | {"reviewers": who, "diagnostics": issues}))
    elif form in ("markdown", "github"):
        print(reports.markdown(listed, summary, who, impact.total or None, issues))
    else:
        print(reports.text(listed, summary, issues), end="")
    return impact.code


def _why(spark, a, s) -> int:
    g = _stored(spark, a, s)
    try:
        found = api.why(g.nodes, g.edges, a.source, a.target, a.reverse)
    except api.Ambiguous as e:
        names = _rows(g.nodes.filter(F.col("id").isin(e.candidates)).select("id", "package", "name", "file_path")) if e.candidates else []
        print(reports.candidates(str(e), names), end="", file=sys.stderr)
        return 3
    print(json.dumps(vars(found), indent=2) if a.format == "json" else reports.path(vars(found)), end="")
    return 0


def _hotspots(spark, a, s) -> int:
    g = _stored(spark, a, s)
    skip = [P.glob_regex(x, basename_fallback=False) for x in [*s.ignore, *T.globs(a.ignore or "")]]
    found = analysis.hotspots(g.nodes, g.edges, T.languages(a.lang or ""), F.col("file_path").rlike("|".join(skip)) if skip else None, a.top)
    found = _rows(found.join(g.nodes.select("id", "file_path", "start_line", "is_export"), "id").orderBy(F.desc("coupling"), F.desc("inbound"), "name", "id"))
    print(json.dumps(found, indent=2) if a.format == "json" else reports.hotspots(found), end="")
    return 0


def _report(spark, a, s) -> int:
    g, diff = _stored(spark, a, s), api.read_diff(a.diff)
    rows, summary = [], {r["key"]: r["n"] for r in api.stats(g.nodes, g.edges).collect()}
    if diff.strip():  # without a diff the page has no overlay
        impact = api.analyze(spark, g.nodes, g.edges, diff, s)
        rows = _rows(impact.affected)
    top = _rows(analysis.most_called(g.nodes, g.edges, reports.TOP))
    with open(a.out, "w", encoding="utf-8") as f:
        f.write(reports.page(rows, summary, hot=top))
    return 0


def _serve(spark, a, s) -> int:
    from cairnspark.server import Service, serve

    serve(Service(spark, os.path.join(a.root, s.graph_path), git.runner(a.root), s), port=a.port).serve_forever()
    return 0


def _validate(spark, a, s) -> int:
    found, states = scip_index.collect(a.root, os.path.join(a.root, ".cairnspark"), _listed(spark, a.root))
    if not found:
        raise ValueError("no SCIP index: " + "; ".join(f"{x.name} {x.state} {x.reason}" for x in states))
    native = api.index(spark, a.root)[0]
    theirs = graph_store.Stored(*api.index_scip(spark, found, a.root), "")
    counts, examples = api.compared(graph_store.Stored(native.nodes, native.edges, ""), theirs, a.root, a.examples)
    out = {r["kind"]: r for r in _rows(counts)}
    shown = {f"{side} {kind}": [r["sig"] for r in _rows(df)] for (side, kind), df in examples.items()}
    print(json.dumps({"counts": out, "examples": shown}, indent=2) if a.format == "json" else reports.comparison(out, shown), end="")
    return 0


def _eval(spark, a, s) -> int:
    report = replay.evaluate(spark, git.runner(a.root), a.max, a.window, a.depth, a.seeds)
    counts, rankers = report.counts.first().asDict(), _rows(report.rankers.orderBy("ranker"))
    if a.format == "json":
        print(json.dumps({"counts": counts, "rankers": rankers, "commits": _rows(report.commits.orderBy("place"))}, indent=2, default=str))
    else:
        print(reports.evaluation(counts, rankers), end="")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairnspark")
    p.add_argument("--root", default=".")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, run, *options):
        one = sub.add_parser(name)
        one.set_defaults(run=run)
        one.add_argument("--format", default=None)
        for flags, kw in options:
            one.add_argument(*flags, **kw)

    number = lambda flag, default: ((flag,), {"type": int, "default": default})
    given = lambda flag: ((flag,), {"default": None})
    switch = lambda flag: ((flag,), {"action": "store_true"})
    add("index", _index, switch("--scip"))
    add("analyze", _analyze, given("--diff"), given("--ignore"), number("--top", None), number("--depth", None), switch("--allow-stale"), switch("--owners"))
    add("why", _why, (("source",), {}), (("target",), {}), switch("--reverse"))
    add("hotspots", _hotspots, number("--top", 10), given("--lang"), given("--ignore"))
    add("report", _report, given("--diff"), (("--out",), {"default": "report.html"}))
    add("serve", _serve, number("--port", 8080))
    add("validate-scip", _validate, number("--examples", 10))
    add("eval", _eval, number("--max", 50), number("--window", 14), number("--depth", 5), number("--seeds", 20))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    settings, warnings = api.Settings.find(a.root)
    for w in warnings:
        print(f"warning: {w}", file=sys.stderr)
    try:
        return a.run(spark or SparkSession.builder.appName("cairnspark").getOrCreate(), a, settings)
    except (ValueError, RuntimeError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
