"""SCIP indexes (Protocol Buffers) as tables of occurrences and symbols."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.functions import paths as P

# Field numbers of the public SCIP schema.
INDEX = {2: "documents", 3: "external"}
DOCUMENT = {1: "relative_path", 2: "occurrences", 3: "symbols", 4: "language"}
OCCURRENCE = {1: "range", 2: "symbol", 3: "roles", 7: "enclosing"}
SYMBOL = {1: "symbol", 4: "relationships", 5: "kind", 6: "display_name", 8: "enclosing_symbol"}
RELATION = {1: "symbol", 2: "is_reference", 3: "is_implementation", 4: "is_type_definition"}

SCHEMA = """at string, ord int, relative_path string, language string,
occurrences array<struct<range:array<int>,symbol:string,roles:int,enclosing:array<int>>>,
symbols array<struct<symbol:string,kind:int,display_name:string,enclosing_symbol:string,relationships:array<struct<symbol:string,is_reference:boolean,is_implementation:boolean,is_type_definition:boolean>>>>"""


def varint(buf: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = buf[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def fields(buf: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message: integers, or the bytes of strings, messages and packed lists."""
    at = 0
    while at < len(buf):
        tag, at = varint(buf, at)
        wire = tag & 7
        if wire == 0:
            value, at = varint(buf, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = buf[at : at + size], at + size
        elif wire == 2:
            size, at = varint(buf, at)
            if at + size > len(buf):
                raise ValueError("a field ends outside its message")
            value, at = buf[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire}")
        yield tag >> 3, value


def numbers(value: int | memoryview) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        n, at = varint(value, at)
        out.append(n)
    return out


def _occurrence(buf: memoryview) -> dict:
    out = {"range": [], "symbol": "", "roles": 0, "enclosing": []}
    for n, v in fields(buf):
        name = OCCURRENCE.get(n)
        if name in ("range", "enclosing"):
            out[name] += numbers(v)
        elif name:
            out[name] = v if isinstance(v, int) else str(v, "utf-8", "replace")
    return out


def _symbol(buf: memoryview) -> dict:
    out = {"symbol": "", "kind": 0, "display_name": "", "enclosing_symbol": "", "relationships": []}
    for n, v in fields(buf):
        name = SYMBOL.get(n)
        if name == "relationships":
            r = {"symbol": "", "is_reference": False, "is_implementation": False, "is_type_definition": False}
            for k, x in fields(v):
                if k in RELATION:
                    r[RELATION[k]] = bool(x) if isinstance(x, int) else str(x, "utf-8", "replace")
            out[name].append(r)
        elif name:
            out[name] = v if isinstance(v, int) else str(v, "utf-8", "replace")
    return out


def documents(data: bytes) -> Iterator[dict]:
    """Documents of an index one by one; then its external symbols as a document without a path."""
    outside = []
    for n, v in fields(memoryview(data)):
        if INDEX.get(n) == "external":
            outside.append(_symbol(v))
        elif INDEX.get(n) == "documents":
            doc = {"relative_path": "", "language": "", "occurrences": [], "symbols": []}
            for k, x in fields(v):
                name = DOCUMENT.get(k)
                if name == "occurrences":
                    doc[name].append(_occurrence(x))
                elif name == "symbols":
                    doc[name].append(_symbol(x))
                elif name:
                    doc[name] = str(x, "utf-8", "replace")
            yield doc
    if outside:
        yield {"relative_path": "", "language": "", "occurrences": [], "symbols": outside}


def decode(indexes: DataFrame) -> DataFrame:
    """indexes: at, content (binary), as `binaryFile` gives them. One row a document. Null content: none. Several
    indexes are united; `ord` orders an index's documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, data in zip(batch["at"], batch["content"], strict=True):
                for i, doc in enumerate(documents(bytes(data))) if data is not None else ():
                    yield pd.DataFrame([{"at": at, "ord": i} | doc], columns=["at", "ord", "relative_path", "language", "occurrences", "symbols"])

    return indexes.select("at", "content").mapInPandas(run, SCHEMA)


def project_documents(docs: DataFrame) -> DataFrame:
    """Documents of the project itself: relative paths that stay inside and avoid generated folders."""
    p = F.replace("relative_path", F.lit("\\"), F.lit("/"))
    bad = (p == "") | (p == ".") | p.rlike(r"^(\.\.(/|$)|/|[A-Za-z]:/)") | p.rlike(r"(^|/)(\.next|node_modules|dist|build|coverage)(/|$)")
    return docs.filter(~bad)


def prefixed(docs: DataFrame, prefix: str) -> DataFrame:
    """Paths of an index made in a subfolder, seen from the root."""
    p = F.col("relative_path")
    return docs.withColumn("relative_path", F.when(p.startswith(prefix + "/"), p).otherwise(F.concat(F.lit(prefix + "/"), p)))


def source_root(at: str) -> str:
    """The root of the sources that an index was made of: the folder it lies in, or the one above .cairnspark/scip."""
    folder = at.replace("\\", "/").rpartition("/")[0] or "."
    return folder.removesuffix("/.cairnspark/scip") if folder.endswith("/.cairnspark/scip") else folder


def source_lines(sources: DataFrame) -> DataFrame:
    """sources: file_path, content. line (from 1 on) and text of every line; of files that several roots have, the first content's."""
    one = sources.groupBy(P.canonical(F.col("file_path")).alias("file_path")).agg(F.min("content").alias("content"))
    lines = one.select("file_path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("i", "text"))
    return lines.select("file_path", (F.col("i") + 1).cast("long").alias("line"), "text")


def definitions_per_document(docs: DataFrame) -> DataFrame:
    """relative_path and how many occurrences of it define something."""
    defines = F.filter("occurrences", lambda o: o["roles"].bitwiseAND(1) != 0)
    return docs.filter("relative_path != ''").groupBy("relative_path").agg(F.sum(F.size(defines)).alias("definitions"))
