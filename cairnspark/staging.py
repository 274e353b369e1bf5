"""Tables staged in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own in local mode (tests), and an error on a cluster,
    whose machines don't see each other's folders."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="cairnspark-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: loops keep a short lineage and survive lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def grown(df: DataFrame, name: str = "", into: DataFrame | None = None) -> DataFrame:
    """A staged table, kept in folders by its column depth, with df's rows appended: one scan however often it grew. df may read
    the table that it is appended to."""
    path = into._cairn_path if into is not None else f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("append").partitionBy("depth").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(t._cairn_path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
