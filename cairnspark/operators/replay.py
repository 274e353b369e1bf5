"""Rankings of a history judged by what became of its commits.

Each commit is replayed on the graph of its own tree. Files are parsed once however many trees hold them (by content); ids carry
the commit, so the graphs don't touch and one traversal analyses all commits at once.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnspark.operators import analysis, build, evaluation
from cairnspark.sources import diffs, files, git, history
from cairnspark.staging import staged

MARK = "\u0002"
DAY_US = 86_400 * 10**6


@dataclass
class Report:
    commits: DataFrame  # place, sha, churn, ladder, ladder_sum, affected, max_fan_in, changed, reverted, hot_fixed, label
    counts: DataFrame  # n, positives, reverted, hot_fixed
    rankers: DataFrame  # ranker, auc, p_at_k, ifa


def labelled(commits: DataFrame, changed: DataFrame, bodies: DataFrame, window_days: int = 14) -> DataFrame:
    """commits: sha, unix_time, fix and more; changed: sha, file; bodies: body. With reverted, hot_fixed and label (0/1)."""
    t = (F.col("unix_time") * 10**6).alias("t")
    touched = commits.select("sha", t, "fix").join(changed, "sha")
    hot = evaluation.hot_fixed(touched, window_days * DAY_US).withColumn("hot_fixed", F.lit(True))
    back = evaluation.reverted(commits, bodies).withColumn("reverted", F.lit(True))
    out = commits.join(hot, "sha", "left").join(back, "sha", "left").na.fill(False, ["hot_fixed", "reverted"])
    return out.withColumn("label", (F.col("hot_fixed") | F.col("reverted")).cast("int"))


def trees(sources: DataFrame) -> DataFrame:
    """sources: sha, file_path, language, content of every tree. Parsed files by tree: a content of one path is parsed once."""
    keyed = sources.withColumn("content_hash", F.sha2("content", 256))
    once = keyed.groupBy("file_path", "content_hash").agg(F.first("language").alias("language"), F.first("content").alias("content"))
    parsed = staged(files.parse(once), "parsed")
    return keyed.select("sha", "file_path", "content_hash").join(parsed, ["file_path", "content_hash"])


def tree_graphs(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all trees, ids marked with their commit. Names are looked up within a tree only, so each tree's graph is
    built by itself; the trees asked for are a bounded list."""
    shas = [r["sha"] for r in parsed.select("sha").distinct().collect()]  # bounded: the last commits asked for
    nodes = edges = None
    for sha in shas:
        one = build.build(parsed.filter(F.col("sha") == sha).drop("sha"))
        tag = lambda c, sha=sha: F.concat(F.lit(sha + MARK), F.col(c)).alias(c)
        n = one.nodes.select(tag("id"), *[c for c in one.nodes.columns if c != "id"], F.lit(sha).alias("sha"))
        e = one.edges.select(tag("source"), tag("target"), "type", "confidence")
        n, e = staged(n, "nodes"), staged(e, "edges")
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
    return nodes, edges


def replayed(nodes: DataFrame, edges: DataFrame, changes: DataFrame, depth: int = 5) -> DataFrame:
    """changes: sha, path, line_ranges, is_new, is_deleted, on the graphs of tree_graphs. sha and the affected functions of every commit, in one traversal."""
    from cairnspark.api import changed_nodes

    shown = nodes.withColumn("file_path", F.concat("sha", F.lit("/"), "file_path"))
    asked = changes.withColumn("path", F.concat("sha", F.lit("/"), "path")).drop("sha")
    seeds = staged(changed_nodes(shown, asked), "seeds")
    found = analysis.affected(nodes, edges, seeds, depth)
    return found.withColumn("sha", F.split("id", MARK)[0])


def evaluate(spark: SparkSession, run: git.Run, most: int = 50, window_days: int = 14, depth: int = 5, seeds: int = 20, ks: Iterable[int] = (5, 10)) -> Report:
    """Ladder, churn and random orders of a repository's last commits, with AUC, precision at k and IFA.

    most bounds what the driver hands out: diffs and trees of the commits asked for. A repository without a commit that has a
    parent raises ValueError."""
    ks = list(ks)
    commits = staged(history.commits(git.log(spark, run, most)), "commits")
    shas = [r["sha"] for r in commits.orderBy("place").select("sha").collect()]
    if not shas:
        raise ValueError("no commit with a parent")
    numstat = git.numstat(spark, run, shas)
    marked = labelled(commits, history.changed_files(numstat), git.bodies(spark, run, most * 3), window_days)
    changes = staged(diffs.changed_files(git.commit_diffs(spark, run, shas), "sha", "diff"), "changes")
    rows = ((s, p, files.language_of(p), b) for s in shas for p, b in git.snapshot(run, s) if files.language_of(p) and len(b) <= files.MAX_BYTES)
    table = spark.createDataFrame(list(rows), "sha string, file_path string, language string, content binary")
    nodes, edges = tree_graphs(staged(trees(table.filter(files.kept_path(F.col("file_path")))), "trees"))
    affected = staged(replayed(nodes, edges, changes, depth), "affected") if nodes is not None else spark.createDataFrame([], "sha string, score long, callers long")
    features = evaluation.commit_features(affected, commits)
    lines = history.churn(numstat).select("sha", "churn")
    number = changes.groupBy("sha").agg(F.count(F.lit(1)).alias("changed"))
    out = marked.join(features, "sha").join(lines, "sha", "left").join(number, "sha", "left").na.fill(0, ["churn", "changed"])
    out = staged(out, "replayed")
    return Report(out, evaluation.report_counts(out), rankers(out, seeds, ks))


def rankers(commits: DataFrame, seeds: int = 20, ks: Iterable[int] = (5, 10)) -> DataFrame:
    """commits: place, label, ladder, churn. Metrics of the ladder, of churn and of random orders."""
    ks = list(ks)
    scored = staged(evaluation.unpivoted(commits, {"ladder": F.col("ladder"), "churn": F.col("churn")}, ["place", "label"]), "scored")
    by_rank = evaluation.metrics(scored, ks, "place", ["ranker"])
    index = F.row_number().over(Window.orderBy("place")) - 1  # the commits asked for, a bounded list
    chance = evaluation.random_baseline(commits.select(index.cast("long").alias("place"), "label"), seeds, ks).drop("orders")
    return by_rank.unionByName(chance.withColumn("ranker", F.lit("random")).select(*by_rank.columns))
