"""The driver's tables viewed as a code graph, commits and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    cols = ["id", "type", "name", "file_path", "start_line", "end_line", "package", "language", "is_export", "is_test"]
    no = F.lit(False)

    def shape(df, prefix, key, kind, name, path, package, language, export, test, lines):
        line = F.col(key).cast("long") * 10 if lines else F.lit(-1).cast("long")
        return df.select(
            F.concat(F.lit(prefix), F.col(key)).alias("id"), F.lit(kind).alias("type"), name.alias("name"), path.alias("file_path"),
            (line + 1).alias("start_line"), (line + (8 if lines else 1)).alias("end_line"), package.alias("package"), F.lit(language).alias("language"), export.alias("is_export"), test.alias("is_test"),
        ).select(*cols)

    nation = t("nation").select("n_nationkey", "n_name")
    src = lambda c: F.concat(F.lit("src/"), c, F.lit(".go"))
    parts = [
        shape(t("region"), "r:", "r_regionkey", "file", F.col("r_name"), src(F.col("r_name")), F.col("r_name"), "go", no, no, False),
        shape(t("nation"), "n:", "n_nationkey", "class", F.col("n_name"), src(F.col("n_name")), F.col("n_name"), "go", no, no, False),
        shape(t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "s:", "s_suppkey", "function", F.col("s_name"), src(F.col("n_name")), F.col("n_name"), "go", F.col("s_acctbal") > 5000, no, True),
        shape(t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "c:", "c_custkey", "function", F.col("c_name"), src(F.col("n_name")), F.col("n_name"), "python", no, F.col("c_mktsegment") == "HOUSEHOLD", True),
        shape(t("part"), "p:", "p_partkey", "function", F.col("p_name"), F.concat(F.lit("lib/"), F.col("p_brand"), F.lit(".ts")), F.col("p_brand"), "typescript", F.col("p_size") >= 25, no, True),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def call_sites(spark: SparkSession, sf: str) -> DataFrame:
    """One row per call site: source, target, confidence."""
    line = table(spark, sf, "lineitem").filter("l_quantity >= 45").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    exact = F.when(F.col("l_returnflag") == "N", "EXACT").otherwise("HEURISTIC").alias("confidence")
    supplier = F.concat(F.lit("s:"), F.col("l_suppkey"))
    a = line.filter("l_quantity >= 50").select(supplier.alias("source"), F.concat(F.lit("p:"), F.col("l_partkey")).alias("target"), exact)
    urgent = table(spark, sf, "orders").filter(F.col("o_orderpriority").startswith("1")).select("o_orderkey", "o_custkey")
    b = line.join(urgent, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c:"), F.col("o_custkey")).alias("source"), supplier.alias("target"), exact)
    return a.unionByName(b)


def dedup_calls(sites: DataFrame) -> DataFrame:
    """One CALLS edge per pair, EXACT if any of its sites is."""
    return sites.groupBy("source", "target").agg(F.min("confidence").alias("confidence")).select("source", "target", F.lit("CALLS").alias("type"), "confidence")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """source, target, type, confidence. Where an edge order matters, it is (type, source, target)."""
    t = lambda n: table(spark, sf, n)
    pair = lambda df, a, ka, b, kb, kind: df.select(F.concat(F.lit(a), F.col(ka)).alias("source"), F.concat(F.lit(b), F.col(kb)).alias("target"), F.lit(kind).alias("type"), F.lit("EXACT").alias("confidence"))
    lowest = t("part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    parts = t("part").join(lowest, "p_name").filter("p_partkey != k")
    n = t("nation").select("n_nationkey", "n_regionkey")
    other = n.select(F.col("n_nationkey").alias("m"), "n_regionkey")
    out = dedup_calls(call_sites(spark, sf))
    for x in (
        pair(n, "r:", "n_regionkey", "n:", "n_nationkey", "CONTAINS"),
        pair(t("supplier"), "n:", "s_nationkey", "s:", "s_suppkey", "CONTAINS"),
        pair(t("customer"), "n:", "c_nationkey", "c:", "c_custkey", "CONTAINS"),
        pair(parts, "p:", "p_partkey", "p:", "k", "EXTENDS"),
        pair(n.join(other, "n_regionkey").filter("n_nationkey != m"), "n:", "n_nationkey", "n:", "m", "IMPORTS"),
    ):
        out = out.unionByName(x)
    return out


def commits(spark: SparkSession, sf: str) -> DataFrame:
    """sha, t (epoch microseconds), file, fix, churn, ladder: events as commits."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("sha"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.col("user_id").alias("file"),
        (F.col("event_type") == "error").alias("fix"),
        F.col("value").alias("churn"),
        F.get_json_object("props", "$.k").cast("long").alias("ladder"),
    )
