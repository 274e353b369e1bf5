"""Places that very many rows share: pairs of all with all, or of one key's rows in one task, would take minutes."""

import time

from pyspark.sql import functions as F

from cairnspark.operators import resolution

MANY = 60_000
#: Seconds that each may take, far below what pairs take.
MOST = 40


def test_methods_and_classes_of_one_directory(spark):
    begin = time.time()
    at = (F.concat(F.lit("d/"), F.col("id") % 3).alias("file_path"), F.lit("d").alias("dir"))
    methods = spark.range(MANY).select(F.concat(F.lit("m"), "id").alias("id"), F.lit("T").alias("receiver"), *at)
    classes = spark.range(MANY).filter("id % 3 != 2").select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("class_id"), F.lit("T").alias("name"), *at)
    got = resolution.method_owners(methods, classes).groupBy("class_id").count().collect()
    assert {tuple(x) for x in got} == {("c000000", 2 * MANY // 3), ("c000001", MANY // 3)}
    assert time.time() - begin < MOST


def test_references_and_scopes_of_one_place(spark):
    begin = time.time()
    name = F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 6, "0"))
    scopes = spark.range(MANY).select(name.alias("id"), F.lit("f").alias("file_path"), F.lit(5).alias("start_line"), F.lit(9).alias("end_line"))
    refs = spark.range(MANY).select(F.col("id").alias("ref"), F.lit("f").alias("file_path"), F.lit(7).alias("line"), F.when(F.col("id") < 10, "s000000").otherwise("x").alias("target"))
    got = resolution.scope_of(refs, scopes).groupBy("scope").count().collect()
    assert {tuple(x) for x in got} == {("s000000", MANY - 10), ("s000001", 10)}
    assert time.time() - begin < MOST


def test_a_scope_with_two_places_is_never_its_own_target(spark):
    scopes = [("a", "f", 1, 90), ("a", "f", 2, 80), ("b", "f", 1, 99), ("c", "f", 5, 5), ("b", "f", 4, 4)]
    refs = [(1, "f", 3, "a"), (2, "f", 3, "b"), (3, "f", 6, "c"), (4, "f", 3, None)]
    got = resolution.scope_of(spark.createDataFrame(refs, "ref int, file_path string, line int, target string"), spark.createDataFrame(scopes, "id string, file_path string, start_line int, end_line int"))
    assert {r["ref"]: r["scope"] for r in got.collect()} == {1: "b", 2: "a", 3: "b"}


def test_markers_above_one_crowded_directory(spark):
    deep = "/".join(f"d{i}" for i in range(400))
    begin = time.time()
    paths = spark.range(5 * MANY).select(F.concat(F.lit(deep + "/f"), "id").alias("path"))
    paths = paths.unionByName(spark.createDataFrame([("x",), ("/x",), ("d0/y",), (None,)], "path string"))
    marks = lambda *dirs: spark.createDataFrame([(x,) for x in dirs], "dir string")
    got = resolution.nearest_marker(paths, marks("d0/d1", ".", "", "d0/d1")).groupBy("dir").count().collect()
    assert {tuple(x) for x in got} == {("d0/d1", 5 * MANY), (".", 2), ("", 1)}
    assert time.time() - begin < MOST
    few = paths.filter("length(path) < 9")
    assert {tuple(x) for x in resolution.nearest_marker(few, marks("d0")).collect()} == {("d0/y", "d0")}


def test_random_orders_are_made_once(spark, monkeypatch):
    from cairnspark.operators import evaluation

    kept, stage = [], evaluation.staged
    monkeypatch.setattr(evaluation, "staged", lambda df, name: kept.append(name) or stage(df, name))
    commits = spark.range(40).select(F.col("id").alias("place"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    assert evaluation.random_baseline(commits, 3).first()["orders"] == 3 and kept == ["orders"]
