"""SCIP indexes read in parts: byte ranges that begin and end at documents.

A first pass over an index reads the heads of its fields alone (number and length) and jumps from one to the next; what lies
between is decoded by the tasks, each a range of some megabytes. Any store that pyarrow opens by its address will do. A document
is never split, so the largest one bounds a task's memory beside the range.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairnspark.sources import scip

RANGE_BYTES = 8 << 20


def opened(path: str) -> pyarrow.NativeFile:
    if "://" in path:
        store, at = pyarrow.fs.FileSystem.from_uri(path)
    else:
        store, at = pyarrow.fs.LocalFileSystem(), path.removeprefix("file:")
    return store.open_input_file(at)


def heads(file: io.BufferedIOBase, size: int) -> Iterator[tuple[int, int, int]]:
    """(field number, begin, end) of an index's fields, heads included. A torn field raises ValueError."""

    def varint() -> int:
        value = shift = 0
        while True:
            byte = file.read(1)
            if not byte:
                raise ValueError("a field ends outside its message")
            value |= (byte[0] & 0x7F) << shift
            if byte[0] < 0x80:
                return value
            shift += 7

    at = 0
    while at < size:
        file.seek(at)
        tag = varint()
        wire = tag & 7
        if wire == 0:
            varint()
        elif wire in (1, 5):
            file.seek(8 if wire == 1 else 4, io.SEEK_CUR)
        elif wire == 2:
            length = varint()
            file.seek(length, io.SEEK_CUR)
        else:
            raise ValueError(f"wire type {wire}")
        end = file.tell()
        if end > size:
            raise ValueError("a field ends outside its message")
        yield tag >> 3, at, end
        at = end


@dataclass
class Part(InputPartition):
    path: str
    spans: list[tuple[int, int]]  # begin, end
    first: int  # ord of the first document
    external: bool


def parts(path: str, range_bytes: int = RANGE_BYTES) -> list[Part]:
    """The parts of one index: documents in their order, then its external symbols. Fields of other kinds are left out."""
    docs, outside, n = [], [], 0
    with opened(path) as raw:
        for number, begin, end in heads(io.BufferedReader(raw, 1 << 16), raw.size()):
            kind = scip.INDEX.get(number)
            if not kind:
                continue
            to = docs if kind == "documents" else outside
            if not to or sum(b - a for a, b in to[-1].spans) >= range_bytes:
                to.append(Part(path, [(begin, end)], n, kind == "external"))
            elif to[-1].spans[-1][1] == begin:
                to[-1].spans[-1] = (to[-1].spans[-1][0], end)
            else:
                to[-1].spans.append((begin, end))
            n += kind == "documents"
    for i, part in enumerate(outside):
        part.first = n + i
    return docs + outside


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["paths"].split("\n")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Part]:
        return [part for path in self.paths for part in parts(path, self.range_bytes)]

    def read(self, part: Part) -> Iterator[tuple]:
        if part is None:  # no index holds anything
            return
        symbols, n = [], part.first
        with opened(part.path) as file:
            for begin, end in part.spans:
                file.seek(begin)
                for doc in scip.documents(file.read(end - begin)):
                    if part.external:
                        symbols += doc["symbols"]
                        continue
                    yield (part.path, n, *(doc[c] for c in ("relative_path", "language", "occurrences", "symbols")))
                    n += 1
        if symbols:
            yield part.path, part.first, "", "", [], symbols


class ScipIndexes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scip_indexes"

    def schema(self) -> str:
        return scip.SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The documents of indexes (at: the path), as scip.decode gives them; external symbols of more than range_bytes are several rows."""
    spark.dataSource.register(ScipIndexes)
    return spark.read.format("scip_indexes").options(paths="\n".join(paths), range_bytes=range_bytes).load()
