"""What the engine is asked for: index, analyze, why, hotspots, compare, stats, evaluate; each on DataFrames."""

from __future__ import annotations

import sys
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.functions import paths as P
from cairnspark.functions.scoring import Thresholds
from cairnspark.operators import analysis, build, compare, scip_build, search
from cairnspark.sinks import graph_store
from cairnspark.sources import diffs, files, history, scip, scip_split
from cairnspark.staging import staged

#: Names that a configuration file may have.
CONFIG_FILES = [".cairnspark.yaml", ".cairnspark.yml"]


@dataclass
class Settings:
    ignore: list[str] = field(default_factory=list)
    max_depth: int = 5
    top: int = 0
    format: str = "text"
    graph_path: str = ".cairnspark/graph.json"
    risk: Thresholds = field(default_factory=Thresholds)

    @classmethod
    def of(cls, given: dict) -> tuple[Settings, list[str]]:
        """Settings of a parsed configuration. Absent keys keep their defaults; so do bad values, with a warning."""
        out, warnings = cls(), []
        for key in ("max_depth", "top"):
            value = given.get(key)
            if isinstance(value, int) and not isinstance(value, bool) and value >= (key == "max_depth"):
                setattr(out, key, value)
            elif value is not None:
                warnings.append(f"{key}: {value!r} is not usable")
        for key in ("format", "graph_path"):
            value = given.get(key)
            if isinstance(value, str) and value:
                setattr(out, key, value)
            elif value is not None:
                warnings.append(f"{key}: {value!r} is not usable")
        out.ignore = [str(x) for x in given.get("ignore") or []]
        names = {"high_callers": "high", "high_exported_callers": "high_exported", "medium_callers": "medium"}
        risk = {}
        for key, value in (given.get("risk") or {}).items():
            if key in names and isinstance(value, int) and value > 0:
                risk[names[key]] = value
            else:
                warnings.append(f"risk.{key}: {value!r} is not usable")
        out.risk = Thresholds(**risk)
        return out, warnings

    @classmethod
    def find(cls, folder: str) -> tuple[Settings, list[str]]:
        """The settings of the nearest configuration file in the folder or above it; the defaults without one, or if it can't be read."""
        for at in (p / name for p in (Path(folder).resolve(), *Path(folder).resolve().parents) for name in CONFIG_FILES):
            if at.is_file():
                try:
                    import yaml
                except ImportError:
                    return cls(), [f"{at}: no YAML reader is installed"]
                try:
                    given = yaml.safe_load(at.read_text(encoding="utf-8")) or {}
                except (OSError, UnicodeDecodeError, yaml.YAMLError) as e:
                    return cls(), [f"{at}: {e}"]
                return cls.of(given) if isinstance(given, dict) else (cls(), [f"{at}: not a mapping"])
        return cls(), []


@dataclass
class Impact:
    changed: DataFrame  # files
    seeds: DataFrame
    affected: DataFrame
    code: int
    total: int = 0  # affected functions, where affected holds only the first of them; else 0


def index(spark: SparkSession, root: str, cache: DataFrame | None = None) -> tuple[build.Graph, DataFrame]:
    """The graph of the sources below root (a local path or any store that Spark reads), and the parsed files to pass as the next call's cache."""
    sources = files.read_sources(files.walk(spark, root))
    if cache is None:
        parsed = files.parse(sources)
    else:
        fresh, kept = files.split_cached(sources, cache)
        parsed = files.parse(fresh).unionByName(kept)
    parsed = staged(parsed, "parsed")
    return build.build(parsed), parsed


def index_scip(spark: SparkSession, indexes: list[tuple[str, str]], root: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of SCIP indexes (path, prefix of its documents), with the sources below root to check and widen them."""
    docs = None
    for path, prefix in indexes:
        one = scip_split.read(spark, [path])
        one = scip.prefixed(one, prefix) if prefix else one
        docs = one if docs is None else docs.unionByName(one)
    sources = files.read_sources(files.walk(spark, root))
    return scip_build.build(staged(docs, "scip"), scip.source_lines(sources), files.parse(sources.filter("language = 'go'")))


def changed_nodes(nodes: DataFrame, changed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Functions that the changed lines overlap (all of a new or deleted file); the file itself where no function does.

    Paths meet by equal suffixes in either direction: the exact path, else the longest, else the first by name. id and seed_ord: functions
    come before files, each in the order of the diff, then of their lines. by: columns of changed that tell diffs apart."""
    by = list(by)
    paths = nodes.select(F.col("file_path").alias("path")).distinct()
    changed = changed.withColumn("path", P.canonical(F.col("path")))
    if "ord" not in changed.columns:
        changed = changed.withColumn("ord", F.lit(0))
    asked = changed.select(F.col("path").alias("diff_path")).distinct()
    down = asked.join(paths.select("path", F.explode(P.suffixes(F.col("path"))).alias("diff_path")), "diff_path")
    up = asked.select("diff_path", F.explode(P.suffixes(F.col("diff_path"))).alias("path")).join(paths, "path").select("diff_path", "path")
    best = analysis.best_match(down.select("diff_path", "path").unionByName(up).distinct())
    x = changed.withColumnRenamed("path", "diff_path").join(best, "diff_path").select(*by, "path", "ord", "is_new", "is_deleted", F.explode_outer("line_ranges").alias("r"))
    f = nodes.filter("type = 'function'").select("id", F.col("file_path").alias("path"), "start_line", "end_line")
    hit = f.join(x, "path").filter("is_new OR is_deleted OR (start_line <= r.end AND r.start <= end_line)")
    hit = hit.groupBy(*by, "id", "path").agg(F.min(F.struct("ord", "start_line")).alias("at"))
    alone = nodes.filter("type = 'file'").select("id", F.col("file_path").alias("path")).join(x.groupBy(*by, "path").agg(F.min("ord").alias("ord")), "path").join(hit, [*by, "path"], "left_anti")
    place = lambda kind, o, line: F.lit(kind << 60) + o.cast("long") * F.lit(1 << 30) + line.cast("long")
    seeds = hit.select(*by, "id", place(0, F.col("at.ord"), F.col("at.start_line")).alias("seed_ord")).unionByName(alone.select(*by, "id", place(1, F.col("ord"), F.lit(0)).alias("seed_ord")))
    return seeds.groupBy(*by, "id").agg(F.min("seed_ord").alias("seed_ord"))


def read_diff(path: str | None = None) -> str:
    """A diff from a file, or from standard input where something is piped in; empty where nothing is."""
    if path and path != "-":
        return Path(path).read_text(encoding="utf-8", errors="replace")
    return "" if sys.stdin is None or sys.stdin.isatty() else sys.stdin.read()


def analyze(spark: SparkSession, nodes: DataFrame, edges: DataFrame, diff: str, settings: Settings | None = None) -> Impact:
    """The impact of a unified diff. An empty diff, or one whose files are all ignored, raises ValueError."""
    s = settings or Settings()
    changed = diffs.changed_files(spark.createDataFrame([(0, diff)], "k int, t string"), "k", "t").drop("k")
    for glob in s.ignore:
        changed = changed.filter(~F.col("path").rlike(P.glob_regex(glob)))
    changed = staged(changed, "changed")
    if changed.isEmpty():
        raise ValueError("the diff changes no file that is not ignored")
    seeds = staged(changed_nodes(nodes, changed), "seeds")
    found = staged(analysis.affected(nodes, edges, seeds, s.max_depth, s.risk, paths=True), "affected")
    n = found.count() if s.top else 0
    return Impact(changed, seeds, analysis.ranked(found, s.top or None), analysis.exit_code(found).first()["code"], n if n > s.top else 0)


def analyze_many(nodes: DataFrame, edges: DataFrame, texts: DataFrame, settings: Settings | None = None) -> DataFrame:
    """texts: diff (its name) and text, as for the commits of a history. What analyze finds for each, as one table with the column diff;
    a diff that changes nothing, a null text or a null name give no rows. One run over shared edges, however many diffs there are."""
    s = settings or Settings()
    changed = diffs.changed_files(texts.select("diff", "text").filter("diff IS NOT NULL AND text IS NOT NULL"), "diff", "text")
    for glob in s.ignore:
        changed = changed.filter(~F.col("path").rlike(P.glob_regex(glob)))
    nodes, edges = staged(nodes, "nodes"), staged(edges, "edges")
    seeds = staged(changed_nodes(nodes, staged(changed, "changed"), by=("diff",)), "seeds")
    return analysis.affected(nodes, edges, seeds, s.max_depth, s.risk, paths=True, stage=False, by=("diff",))


def owned(impact: Impact, nodes: DataFrame, authors: DataFrame | None = None, rules: list | None = None) -> tuple[DataFrame, DataFrame]:
    """The affected functions with their files and last authors, and the reviewers: a file counts once for each affected function
    of it and once if it has changed itself."""
    rows = impact.affected.join(nodes.select("id", "file_path"), "id")
    if authors is not None:
        rows = history.with_authors(rows, authors)
    every = rows.select(F.col("file_path").alias("path")).unionByName(impact.changed.select("path"))
    return rows, history.reviewers(every, rules or [])


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """key and n: nodes by type, edges by type, nodes by language (blank ones aside)."""
    keys = nodes.select(F.explode(F.array(F.concat(F.lit("node:"), "type"), F.concat(F.lit("language:"), "language"))).alias("key")).unionByName(edges.select(F.concat(F.lit("edge:"), "type").alias("key")))
    return keys.filter("key != 'language:'").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


class Ambiguous(ValueError):
    """A name means several functions, or none; candidates are the first of them."""

    def __init__(self, name: str, candidates: list[str]):
        super().__init__(f"no function matches {name!r}" if not candidates else f"{name!r} is ambiguous")
        self.candidates = candidates


def resolve(nodes: DataFrame, name: str) -> str:
    """The id of the one function that a name means."""
    found = search.unique_name(staged(search.name_search(nodes, name), "matches")).first()
    if found is None or found["id"] is None:
        raise Ambiguous(name, list(found["candidates"] or []) if found else [])
    return found["id"]


def why(nodes: DataFrame, edges: DataFrame, source: str, target: str, reverse: bool = False) -> search.Path:
    """How one function comes to call another, both by name."""
    return search.call_path(nodes, edges, resolve(nodes, source), resolve(nodes, target), reverse)


def compared(base: graph_store.Stored, candidate: graph_store.Stored, root: str = "", most: int = 0) -> tuple[DataFrame, dict[tuple[str, str], DataFrame]]:
    """Counts of shared, missing and extra nodes and edges, and examples by (side, kind)."""
    found = staged(compare.sides(compare.signatures(base.nodes, base.edges, root), compare.signatures(candidate.nodes, candidate.edges, root)), "sides")
    return compare.counts(found), {(s, k): compare.examples(found, s, k, most) for s in ("missing", "extra") for k in ("node", "edge")}
