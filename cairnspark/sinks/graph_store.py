"""Graphs kept as Parquet tables, or as one JSON document for other tools."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.functions.paths import normal_remote

NODE = "id string, type string, name string, file_path string, start_line bigint, end_line bigint, package string, language string, is_export boolean, is_test boolean, is_init boolean"
EDGE = "source string, target string, type string, confidence string"
DOC = f"root_path string, commit string, repo_remote string, nodes array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<{EDGE.replace(' ', ':').replace(',:', ',')}>>"


@dataclass
class Stored:
    nodes: DataFrame
    edges: DataFrame
    commit: str
    remote: str = ""
    root: str = ""


class StaleGraph(RuntimeError):
    """The graph was built at another commit than the one asked for."""


def save_tables(nodes: DataFrame, edges: DataFrame, path: str, commit: str = "") -> None:
    """nodes and edges as Parquet below path: the form for graphs of any size. Rows carry the commit, edges their edge_ord if they have one."""
    nodes.withColumn("commit", F.lit(commit)).write.mode("overwrite").parquet(f"{path}/nodes")
    edges.withColumn("commit", F.lit(commit)).write.mode("overwrite").parquet(f"{path}/edges")


def load_tables(spark: SparkSession, path: str) -> Stored:
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    row = nodes.select("commit").limit(1).collect()
    return Stored(nodes.drop("commit"), edges.drop("commit"), row[0][0] if row else "")


def save_json(nodes: DataFrame, edges: DataFrame, path: str, commit: str = "", remote: str = "", root: str = "") -> None:
    """One JSON document beside the driver, written whole or not at all. Rows stream through the driver one by one,
    nodes by id and edges in the order that traversals follow: by edge_ord, else by type, source and target; for large graphs use save_tables."""
    spark = nodes.sparkSession
    if remote:
        remote = spark.range(1).select(normal_remote(F.lit(remote))).first()[0]
    tmp = f"{path}.tmp"
    in_order = edges.orderBy("edge_ord").drop("edge_ord") if "edge_ord" in edges.columns else edges.orderBy("type", "source", "target")
    with open(tmp, "w", encoding="utf-8") as out:
        out.write("{" + f'"root_path": {json.dumps(root)}, "commit": {json.dumps(commit)}, "repo_remote": {json.dumps(remote)}')
        for name, df in (("nodes", nodes.orderBy("id")), ("edges", in_order)):
            out.write(f',\n"{name}": [')
            for i, row in enumerate(df.select(F.to_json(F.struct(*df.columns)).alias("j")).toLocalIterator()):
                out.write(("," if i else "") + "\n  " + row["j"])
            out.write("]")
        out.write("}\n")
        out.flush()
        os.fsync(out.fileno())
    Path(tmp).replace(path)


def load_json(spark: SparkSession, path: str) -> Stored:
    """Absent fields read as empty, zero or false; an edge without a confidence is EXACT. Edges keep their place as edge_ord."""
    doc = spark.read.schema(DOC).option("multiLine", True).json(path)
    zero = {"string": "", "bigint": 0, "boolean": False}
    nodes = doc.select(F.inline("nodes"))
    nodes = nodes.na.fill({c: zero[t] for c, t in nodes.dtypes})
    edges = doc.select(F.posexplode("edges").alias("edge_ord", "e")).select("e.*", F.col("edge_ord").cast("long").alias("edge_ord"))
    edges = edges.withColumn("confidence", F.coalesce(F.nullif("confidence", F.lit("")), F.lit("EXACT")))
    row = doc.select("commit", "repo_remote", "root_path").first()
    return Stored(nodes, edges, *((x or "") for x in (row or ("", "", ""))))


def require_fresh(stored: Stored, head: str, allow_stale: bool = False) -> None:
    """Raises StaleGraph where both commits are known and differ."""
    if not allow_stale and head and stored.commit and stored.commit != head:
        raise StaleGraph(f"the graph is of {stored.commit[:7]}, the tree of {head[:7]}")
