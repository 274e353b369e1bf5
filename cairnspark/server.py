"""The engine behind HTTP: answers as plain functions on a loaded graph, and a small server around them."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession

from cairnspark import api
from cairnspark.operators import analysis
from cairnspark.sinks import graph_store
from cairnspark.sources import git, history

MAX_BODY = 10 << 20


class Refused(ValueError):
    def __init__(self, message: str, status: int = 400):
        super().__init__(message)
        self.status = status


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _number(text: str | None, default: int) -> int:
    return int(text) if text and text.isdigit() and int(text) > 0 else default


class Service:
    """Answers on one graph, which reload replaces as a whole: a request that has begun keeps the graph it began with."""

    def __init__(self, spark: SparkSession, path: str, run: git.Run | None = None, settings: api.Settings | None = None):
        self.spark, self.path, self.run, self.settings = spark, path, run, settings or api.Settings()
        self.lock = threading.Lock()
        self.graph = graph_store.load_json(spark, path)

    def _now(self) -> graph_store.Stored:
        with self.lock:
            return self.graph

    def repo(self) -> dict:
        g = self._now()
        return {"remote": g.remote, "commit": g.commit, "root_path": g.root}

    def whole(self) -> dict:
        """The slim graph. Its answer is as large as the graph: for graphs of a dashboard's size."""
        g = self._now()
        return {"nodes": _rows(g.nodes), "edges": _rows(g.edges.drop("edge_ord"))}

    def stats(self) -> dict:
        g, out = self._now(), {"node_types": {}, "edge_types": {}, "languages": {}}
        names = {"node": "node_types", "edge": "edge_types", "language": "languages"}
        for r in api.stats(g.nodes, g.edges).collect():
            kind, _, key = r["key"].partition(":")
            out[names[kind]][key] = r["n"]
        return {"total_nodes": sum(out["node_types"].values()), "total_edges": sum(out["edge_types"].values())} | out

    def hotspots(self, top: str | None = None, lang: str | None = None) -> dict:
        g, n = self._now(), _number(top, 20)
        found = analysis.hotspots(g.nodes, g.edges, [lang] if lang else None, top=n)
        return {"hotspots": _rows(found), "top_n": n}

    def analyze(self, diff: str, depth: str | None = None) -> dict:
        if not diff.strip():
            raise Refused("empty diff body")
        g = self._now()
        s = api.Settings(self.settings.ignore, _number(depth, 5), self.settings.top, risk=self.settings.risk)
        try:
            impact = api.analyze(self.spark, g.nodes, g.edges, diff, s)
        except ValueError as e:
            raise Refused(str(e)) from e
        authors, rules = None, []
        if self.run:
            paths = [r[0] for r in impact.affected.join(g.nodes.select("id", "file_path"), "id").select("file_path").distinct().collect()]
            authors = history.last_authors(git.author_log(self.spark, self.run, paths)) if paths else None
            rules = history.owner_rules(history.owner_file(git.root(self.run)))
        rows, reviewers = api.owned(impact, g.nodes, authors, rules)
        return {"changed": _rows(impact.changed), "affected": _rows(analysis.ranked(rows)), "reviewers": _rows(reviewers), "code": impact.code, "total_affected": impact.total}

    def working_diff(self, depth: str | None = None) -> dict:
        """The working tree's own changes; no revision can be asked for."""
        if not self.run:
            raise Refused("no repository is served")
        try:
            diff = git.working_diff(self.run)
        except RuntimeError as e:
            raise Refused(str(e)) from e
        if not diff:
            raise Refused("no changes found", 404)
        return self.analyze(diff, depth)

    def reload(self) -> dict:
        try:
            fresh = graph_store.load_json(self.spark, self.path)
            nodes, edges = fresh.nodes.count(), fresh.edges.count()
        except Exception as e:  # whatever the reader raises, the graph that is served stays
            raise Refused(f"reloading graph: {e}", 500) from e
        with self.lock:
            self.graph = fresh
        return {"status": "reloaded", "nodes": nodes, "edges": edges}

    def routes(self) -> dict[tuple[str, str], Callable[[dict, str], dict]]:
        return {
            ("GET", "/api/graph"): lambda q, _: self.whole(),
            ("GET", "/api/repo"): lambda q, _: self.repo(),
            ("GET", "/api/stats"): lambda q, _: self.stats(),
            ("GET", "/api/hotspots"): lambda q, _: self.hotspots(q.get("top"), q.get("lang")),
            ("POST", "/api/analyze"): lambda q, body: self.analyze(body, q.get("depth")),
            ("GET", "/api/analyze/diff"): lambda q, _: self.working_diff(q.get("depth")),
            ("POST", "/api/reload"): lambda q, _: self.reload(),
        }

    def answer(self, method: str, url: str, body: str = "") -> tuple[int, dict]:
        """Status and answer of a request."""
        at = urlsplit(url)
        handler = self.routes().get((method, at.path))
        if handler is None:
            return 404, {"error": "not found"}
        try:
            return 200, handler({k: v[0] for k, v in parse_qs(at.query).items()}, body)
        except Refused as e:
            return e.status, {"error": str(e)}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is bound and not yet running (serve_forever)."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            body = self.rfile.read(min(int(self.headers.get("Content-Length") or 0), MAX_BODY)).decode("utf-8", "replace")
            status, out = service.answer(self.command, self.path, body)
            data = json.dumps(out, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _do

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
