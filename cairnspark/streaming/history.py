"""Streams of commits and of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairnspark.sources import files


def fixed_later(commits: DataFrame, fixes: DataFrame, window: str, late: str = "1 hour") -> DataFrame:
    """commits, fixes: sha, ts, file. Commits with the fix that follows within the window on one of their files: a join of
    two streams (or tables). Both watermarks and the bounded interval let Spark drop state; one row a pair."""
    c = commits.select("sha", "ts", "file").withWatermark("ts", late)
    f = fixes.select(F.col("sha").alias("fix_sha"), F.col("ts").alias("fix_ts"), F.col("file").alias("fix_file")).withWatermark("fix_ts", late)
    after = (F.col("file") == F.col("fix_file")) & (F.col("fix_ts") > F.col("ts")) & (F.col("fix_ts") <= F.col("ts") + F.expr(f"INTERVAL {window}"))
    return c.join(f, after).select("sha", "file", "ts", "fix_sha", "fix_ts")


def churn_windows(commits: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    """commits: ts, file, churn. Churn and commits per file and window."""
    w = commits.withWatermark("ts", late).groupBy(F.window("ts", size), "file").agg(F.round(F.sum("churn"), 4).alias("churn"), F.count(F.lit(1)).alias("commits"))
    return w.select(F.col("window.start").alias("start"), "file", "churn", "commits")


def index_stream(sources: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """sources: a stream of file_path, language, content. Parses what arrives; a batch that is replayed after a failure
    overwrites its own folder, so no file is stored twice."""

    def parse(batch: DataFrame, n: int) -> None:
        files.parse(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return sources.writeStream.foreachBatch(parse).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
