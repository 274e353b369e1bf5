"""Source files as a table, and that table parsed."""

from __future__ import annotations

import hashlib
import os
import signal
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pandas as pd
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by ending, folders that are not walked, the largest file read.
LANGUAGES = {".go": "go", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python"}
SKIPPED = {"node_modules", ".git", "vendor", "__pycache__", "dist", "build", ".next"}
DOT_ALLOWED = {".github"}
MAX_BYTES = 10 * 1024 * 1024
#: Seconds that the parsing of one file may take.
PARSE_SECONDS = 30.0

RESULT = """file_path string, language string, package string, is_test_file boolean, content_hash string, error string,
functions array<struct<name:string,start_line:bigint,end_line:bigint,receiver:string,is_export:boolean,is_init:boolean,decorators:array<string>>>,
calls array<struct<name:string,line:bigint,receiver:string,receiver_type:string,receiver_key:string>>,
imports array<struct<path:string,alias:string,symbol:string,line:bigint>>,
classes array<struct<name:string,start_line:bigint,end_line:bigint,is_export:boolean,kind:string,bases:array<string>>>,
facts array<struct<to:string,kind:string,of:string,step:string>>"""


def language_of(name: str) -> str | None:
    """By ending; minified scripts have none."""
    if name.lower().endswith((".min.js", ".min.jsx")):
        return None
    return LANGUAGES.get(os.path.splitext(name)[1])


def kept_path(path: Column) -> Column:
    """A relative path below none of the folders that aren't walked."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return ~F.exists(folders, lambda f: f.isin(sorted(SKIPPED)) | (f.startswith(".") & ~f.isin(sorted(DOT_ALLOWED))))


def skipped_root(root: str) -> bool:
    """A root that is itself a folder that isn't walked holds nothing."""
    name = os.path.basename(os.path.normpath(root))
    return name in SKIPPED or (name.startswith(".") and name not in {".", "..", *DOT_ALLOWED})


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, or of an address in a store, and the path there."""
    return pafs.FileSystem.from_uri(root if "://" in root else Path(root).absolute().as_uri())


def _entries(fs: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    """What a folder holds, links aside; nothing where it can't be read."""
    try:
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    except OSError:
        return []
    return [x for x in found if not (isinstance(fs, pafs.LocalFileSystem) and os.path.islink(x.path))]


def _walked(name: str) -> bool:
    return name not in SKIPPED and (not name.startswith(".") or name in DOT_ALLOWED)


def _below(fs: pafs.FileSystem, info: pafs.FileInfo) -> Iterator[pafs.FileInfo]:
    """Files with a language at or below an entry."""
    left = [info]
    while left:
        x = left.pop()
        if x.type == pafs.FileType.Directory and _walked(x.base_name):
            left += _entries(fs, x.path)
        elif x.type == pafs.FileType.File and language_of(x.base_name):
            yield x


def walk(spark: SparkSession, root: str) -> DataFrame:
    """file_path (relative), language, at, size: the source files below root, a path or the address of a store. Links aren't followed,
    and folders that can't be read are passed over.

    The driver lists the root alone; executors walk what is below each of its entries. (Spark's own listing leaves out names that
    begin with an underscore, which __init__.py does.)"""
    schema = "file_path string, language string, at string, size long"
    if skipped_root(root):
        return spark.createDataFrame([], schema)
    fs, base = _opened(root)
    plain = root.rstrip("/")
    store = plain[: len(plain) - len(base)] if plain.endswith(base) and not isinstance(fs, pafs.LocalFileSystem) else ""
    names = sorted(x.base_name for x in _entries(fs, base))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _opened(root)
        for batch in batches:
            for info in fs.get_file_info([f"{base}/{n}" for n in batch["name"]]):
                rows = [(x.path[len(base) + 1 :], language_of(x.base_name), store + x.path, x.size) for x in _below(fs, info)]
                if rows:
                    yield pd.DataFrame(rows, columns=["file_path", "language", "at", "size"])

    if not names:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame([(n,) for n in names], "name string").repartition(min(len(names), 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, schema)


def read_sources(listing: DataFrame) -> DataFrame:
    """file_path, language, content of what walk lists. Files above MAX_BYTES and unreadable ones are left out.

    Names are dealt out anew before they are read, so one large folder is read by many tasks."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, language, at in zip(batch["file_path"], batch["language"], batch["at"], strict=True):
                try:
                    fs, name = _opened(at)
                    with fs.open_input_stream(name) as f:
                        data = f.read()
                except OSError:
                    continue
                yield pd.DataFrame({"file_path": [path], "language": [language], "content": [data]})

    listed = listing.filter(F.col("size") <= MAX_BYTES).repartition(listing.sparkSession.sparkContext.defaultParallelism, "file_path")
    return listed.mapInPandas(load, "file_path string, language string, content binary")


@contextmanager
def at_most(seconds: float) -> Iterator[None]:
    """Raises TimeoutError in what runs longer. In the main thread of a process, where Python workers parse; elsewhere no limit."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_):
        raise TimeoutError(f"took longer than {seconds} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def parse(sources: DataFrame) -> DataFrame:
    """sources: file_path, language, content (binary). One row a file; a file that doesn't parse keeps its row with an error.

    Narrow, one file at a time. Null content reads as empty; unknown languages give no definitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from cairnspark.sources import parsers

        for batch in batches:
            rows = []
            for path, language, data in zip(batch["file_path"], batch["language"], batch["content"], strict=True):
                data = bytes(data) if data is not None else b""
                found, error = parsers.empty(), None
                try:
                    if language in parsers.PARSERS:
                        with at_most(PARSE_SECONDS):
                            found |= parsers.PARSERS[language](data.decode("utf-8", "replace"))
                except (SyntaxError, ValueError, RecursionError, TimeoutError) as e:
                    error = f"{type(e).__name__}: {e}"
                rows.append({"file_path": path, "language": language, "is_test_file": parsers.is_test(path or "", language), "content_hash": hashlib.sha256(data).hexdigest(), "error": error} | found)
            yield pd.DataFrame(rows, columns=["file_path", "language", "package", "is_test_file", "content_hash", "error", "functions", "calls", "imports", "classes", "facts"])

    return sources.select("file_path", "language", F.col("content").cast("binary").alias("content")).mapInPandas(run, RESULT)


def split_cached(sources: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sources to parse anew, and the cache's rows that still hold (same path and content hash)."""
    now = sources.withColumn("content_hash", F.sha2(F.col("content"), 256))
    fresh = now.join(cache.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_anti").drop("content_hash")
    return fresh, cache.join(now.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_semi").select(*cache.columns)


def _saved(spark: SparkSession, path: str) -> list:
    """Whole versions of a cache, the newest last: those that have Spark's mark of a job that ended."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted((x for x in found if x.getName().startswith("at-") and fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))), key=lambda x: x.getName())


def save_cache(parsed: DataFrame, path: str) -> None:
    """Parsed files as Parquet, in a folder of their own below path. Older versions go once this one is whole; if the job
    fails, they are what load_cache reads."""
    spark = parsed.sparkSession
    old = _saved(spark, path)
    parsed.write.parquet(f"{path}/at-{time.time_ns():020}-{uuid.uuid4().hex}")
    for x in old:
        x.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(x, True)


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """The newest parsed files that were saved whole; an empty table where there are none, or something else."""
    whole = _saved(spark, path)
    try:
        found = spark.read.parquet(whole[-1].toString() if whole else path)
        if {"file_path", "content_hash", "functions", "facts"} <= set(found.columns):
            return found
    except AnalysisException:
        pass
    return spark.createDataFrame([], RESULT)
