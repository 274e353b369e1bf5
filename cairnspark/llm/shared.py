"""Places that driver and executors share, and tables staged there."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that Spark hands to a Python worker at once, where the session doesn't say otherwise.
BATCH_BYTES = 4 << 20
#: Bytes of a partition, where we choose.
PART_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, one of our own in local mode
    (tests), and an error on a cluster, whose machines don't see each other's folders."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="cairnspark-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def parts(spark: SparkSession, of_bytes: int) -> int:
    """Partitions of PART_BYTES for so many bytes; never fewer than there are cores."""
    return max(spark.sparkContext.defaultParallelism, -(-of_bytes // PART_BYTES))


def staged(df: DataFrame, name: str, small: int | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage and partitioning.

    small: the bytes of df, roughly, where they are few beside what its tasks read: it is dealt out anew into as many files
    as they are worth, instead of one for each of many tasks. (Coalescing would have one task hold what many need.)"""
    spark = df.sparkSession
    bound_batches(spark)
    if small is not None:
        df = df.repartition(parts(spark, small))
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more: what was made of them has been written itself."""
    for t in tables:
        drop_path(t.sparkSession, t._cairn_path)


def forget_shuffles(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark deletes the shuffle files of what is done; else they
    stay until the driver happens to. Python's own garbage goes first: it may hold frames; what that frees in the JVM
    goes in a second round."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a staged path in whatever file system it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
