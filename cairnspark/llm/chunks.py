"""Corpus counts of many keys, brought to the texts that have them.

Texts are tagged with a chunk of bounded size once and staged. A scan of that table asks for the counts
of its keys in cells, one for each range of the key space that it has keys in; a range is summed in one place
and answers every cell in the order asked. A scan may cut a chunk anywhere (another executor count, a
retry): a cell names the run of rows that it stands for, so the answers always fit the texts.

Cells are never more than keys, and ranges grow with the input, up to a bound, to keep cells large.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cairnspark.llm import textkernel as K
from cairnspark.llm.shared import parts, staged

#: Bytes of text whose keys one range has: at least so many, at most so many, and else a share of all.
RANGE_BYTES, RANGE_MOST, RANGE_SHARE = 8 << 20, 24 << 20, 4096
#: What a row of a chunk counts beside its text.
ROW_BYTES = 64
_LOW = np.uint64(0xFFFFFFFF)


def ranges_of(text_bytes: int) -> int:
    return max(1, -(-text_bytes // min(max(RANGE_BYTES, text_bytes // RANGE_SHARE), max(RANGE_BYTES, RANGE_MOST))))


def tagged(rows: DataFrame, limit: int, text_bytes: int) -> DataFrame:
    """rows, one of whose columns is t (text_bytes in all), staged with row (a number of its own) and chunk (the row of its
    chunk's first). A chunk has limit bytes of text, a row counting ROW_BYTES more, or one row."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = chunk = TaskContext.get().partitionId() << 40
        used = 0
        for b in batches:
            own, chunks = np.arange(at, at + b.num_rows), np.empty(b.num_rows, np.int64)
            for k, n in enumerate(pc.fill_null(pc.binary_length(b.column(names.index("t"))), 0).to_pylist()):
                if used + n > limit and used:
                    chunk, used = at + k, 0
                chunks[k] = chunk
                used += n + ROW_BYTES
            yield pa.RecordBatch.from_arrays([pa.array(chunks), pa.array(own), *b.columns], names=["chunk", "row", *names])
            at += b.num_rows

    schema = ", ".join(["chunk long", "row long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)])
    # coalesced before the numbering, which goes by partition
    return staged(rows.coalesce(parts(rows.sparkSession, text_bytes)).mapInArrow(run, schema), "chunks")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one chunk that follow each other, as far as this scan has them. The first two columns are chunk and row."""
    K.release()
    held, chunk, after = [], None, None
    for b in batches:
        if not b.num_rows:
            continue
        c, r = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(c) != 0) | (np.diff(r) != 1)) + 1).tolist(), len(c)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and (c[lo] != chunk or r[lo] != after):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            chunk, after = c[lo], r[hi - 1] + 1
    if held:
        yield pa.Table.from_batches(held)
    K.release()


def cells(run: pa.Table, keys: list[np.ndarray], edges: list[np.ndarray]) -> Iterator[tuple[list, list[slice]]]:
    """For each range of which a run has keys (and for the first in any case): range, chunk, first row, rows; and the
    slices of its sorted keys of each kind. edges: of each kind, the least key of each range."""
    cut = [np.append(np.searchsorted(k, e), len(k)) for k, e in zip(keys, edges, strict=True)]
    some = sum(np.diff(c) for c in cut) > 0
    some[0] = True
    chunk, row = run["chunk"][0].as_py(), run["row"][0].as_py()
    for r in np.flatnonzero(some).tolist():
        yield [r, chunk, row, run.num_rows], [slice(int(c[r]), int(c[r + 1])) for c in cut]


def answered(texts: pa.Table, answers: pa.Table) -> Iterator[tuple[pa.Table, pa.Table]]:
    """The runs of one chunk's texts, each with its answers in the order of the ranges."""
    texts, answers = texts.sort_by("row"), answers.sort_by([("row", "ascending"), ("r", "ascending")])
    first, rows = answers["row"].to_numpy(), answers["rows"].to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), len(first)] if len(first) else [0]
    begin, done = (texts["row"][0].as_py() if texts.num_rows else 0), 0
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if first[lo] - begin != done:
            raise AssertionError("answers that fit no run of this chunk")
        yield texts.slice(done, int(rows[lo])), answers.slice(lo, hi - lo)
        done += int(rows[lo])
    if done != texts.num_rows:
        raise AssertionError("texts without answers")


def packed_counts(n: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them, compressed (most are alike), after a byte that gives its width."""
    kind = np.min_scalar_type(n.max(initial=0))
    return bytes([kind.itemsize]) + zlib.compress(n.astype(kind).tobytes(), 1)


def unpacked_counts(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(memoryview(x)[1:]), f"u{x[0]}").astype(np.int64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their steps: the lower 32 bits of each as they are, the upper ones compressed (few differ from 0)."""
    step = np.diff(keys, prepend=np.uint64(0))
    high = step >> np.uint64(32)
    kind = np.min_scalar_type(high.max(initial=0))
    return bytes([kind.itemsize]) + (step & _LOW).astype(np.uint32).tobytes() + zlib.compress(high.astype(kind).tobytes(), 1)


def unpacked_keys(x: bytes, n: int) -> np.ndarray:
    low = np.frombuffer(x, np.uint32, n, 1)
    high = np.frombuffer(zlib.decompress(memoryview(x)[1 + 4 * n :]), f"u{x[0]}")
    return np.cumsum(low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)), dtype=np.uint64)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of each cell the total counts of its keys in its order; and the distinct keys and their totals."""
    uniq, _, number = K.numbered(np.concatenate(keys))
    total = np.bincount(number, np.concatenate(counts), len(uniq)).astype(np.int64)
    return np.split(total[number], np.cumsum([len(k) for k in keys])[:-1]), uniq, total
