"""Token-id output in Arrow files of fixed-size-list batches.

Documents are encoded in ascending id order and packed without gaps into sequences of equal
length. Each partition writes two Arrow IPC files: ``.seq.arrow`` holds batches of a
fixed-size list of ids and one of a mask (false on padding), so sequence i lies in batch
i // rows at row i % rows and is read from a memory map without copying; ``.doc.arrow`` holds
each document's id, start and length. Ids take 16 bits where the vocabulary allows it.

A task writes under a name of its own and reports it; only files reported by tasks that
succeeded count, so a lost executor or a repeated task leaves no double rows.
"""

from __future__ import annotations

import functools
import json
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm import pretokens
from cairnspark.llm import textkernel as K
from cairnspark.llm.shared import fresh_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
LENGTH = 2048
ROWS = 64
#: Distinct words that a Python worker remembers (about 130 bytes each); beyond that it forgets all.
WORDS_KEPT = 1 << 19
#: Bytes of text encoded at once, and in one file.
PIECE_BYTES, FILE_BYTES = 6 << 20, 32 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordModel:
    """The library's tokenizer, and a copy without normaliser and cutting for words that need neither."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        spec["normalizer"] = None
        spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        spec["added_tokens"] = []
        self.bare = Tokenizer.from_str(json.dumps(spec))
        self.kept: dict[bytes, bytes] = {}
        self.dtype = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32

    def ids(self, tokenizer, words: list[bytes]) -> list[bytes]:
        code = "H" if self.dtype is np.uint16 else "I"
        return [array(code, x.ids).tobytes() for x in tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]


@functools.lru_cache(2)
def load(path: str) -> WordModel:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordModel(path)


def _lowered(buf: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of U+00C0 to U+00DE."""
    out = K.LOWER[buf]
    second = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
    out[second] += 0x20
    return out


def encode_texts(model: WordModel, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids end to end, and where each text begins (one more at the end)."""
    alone = {i: t for i, t in enumerate(texts) if t and any(x in t for x in model.special)}
    plain = [b"" if t is None or i in alone else t for i, t in enumerate(texts)]
    at = np.zeros(len(plain) + 1, np.int64)
    np.cumsum([len(t) for t in plain], out=at[1:])
    raw = b"".join(plain)
    buf = np.frombuffer(raw, np.uint8)
    s, e, by_library, cls = pretokens.cut(buf, at, spaces_join=False, extended=False)
    if not len(s):
        flat, starts = np.empty(0, model.dtype), np.zeros(len(texts) + 1, np.int64)
    else:
        low = _lowered(buf)
        if by_library.any():  # such words go to the library as they are
            k = np.flatnonzero(by_library)
            width = e[k] - s[k]
            j = np.repeat(s[k] - (np.cumsum(width) - width), width) + np.arange(width.sum())
            low[j] = buf[j]
        whole = low.tobytes()
        _, first, codes = K.numbered(K.segment_hashes(low, s, e))
        strings = [whole[a:b] for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)]
        results = list(map(model.kept.get, strings))
        missing = [k for k, r in enumerate(results) if r is None]
        letters = ((cls[first] == pretokens.LETTER) & ~by_library[first]).tolist()
        for bare in (True, False):
            own = [k for k in missing if letters[k] == bare]
            for k, ids in zip(own, model.ids(model.bare if bare else model.library, [strings[k] for k in own]), strict=True):
                results[k] = ids
        if len(model.kept) + len(missing) > WORDS_KEPT:
            model.kept.clear()
        if len(missing) <= WORDS_KEPT:
            model.kept.update((strings[k], results[k]) for k in missing)
        table = np.frombuffer(b"".join(results), model.dtype)
        size = np.fromiter(map(len, results), np.int64, len(results)) // table.itemsize
        offset = np.cumsum(size) - size
        width = size[codes]
        ends = np.cumsum(width)
        flat = table[np.repeat(offset[codes] - (ends - width), width) + np.arange(ends[-1])]
        starts = np.append(0, ends)[np.searchsorted(s, at)]
    if alone:
        parts = [flat[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        for i, t in alone.items():
            parts[i] = np.array(model.library.encode(t.decode(), add_special_tokens=False).ids, model.dtype)
        flat, starts = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
    return flat, starts


def _schema(dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Packs ids into sequences and writes them batch by batch; holds one batch at most."""

    def __init__(self, stream, dtype, length: int = LENGTH, rows: int = ROWS):
        self.length, self.rows, self.n = length, rows, 0
        self.schema = _schema(dtype, length)
        self.file = pa.ipc.new_file(stream, self.schema)
        self.held, self.held_n = [], 0

    def write(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.held_n += len(ids)
        self.n += len(ids)
        if self.held_n >= self.length * self.rows:
            self._flush(self.length * self.rows)

    def _flush(self, step: int, last: bool = False) -> None:
        flat = np.concatenate(self.held) if self.held else np.empty(0, np.uint16)
        done = 0
        while len(flat) - done >= step or (last and done < len(flat)):
            part = flat[done : done + step]
            done += len(part)
            seqs = -(-len(part) // self.length)
            pad = seqs * self.length - len(part)
            mask = np.ones(seqs * self.length, bool)
            if pad:
                mask[len(part) :] = False
                part = np.concatenate([part, np.zeros(pad, part.dtype)])
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)]
            self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.held, self.held_n = [flat[done:].copy()], len(flat) - done

    def close(self) -> None:
        self._flush(self.length * self.rows, last=True)
        self.file.close()


class SequenceReader:
    """Random access to a sequence file; holds one batch at a time."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.batch_at, self.batch, self.rows = -1, None, None

    def _batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k != self.batch_at:
            b = self.file.get_batch(k)
            self.batch_at = k
            self.batch = (b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False))
        return self.batch

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i: views into the file's buffer for the ids."""
        if self.rows is None:
            self.rows = self.file.get_batch(0).num_rows
        ids, mask = self._batch(i // self.rows)
        k = i % self.rows * self.length
        return ids[k : k + self.length], mask[k : k + self.length]

    def slice(self, start: int, n: int) -> np.ndarray:
        """n ids from position start on."""
        if not n:
            return np.empty(0, np.uint16)
        if self.rows is None:
            self.rows = self.file.get_batch(0).num_rows
        step, out = self.rows * self.length, []
        while n:
            k, lo = divmod(start, step)
            part = self._batch(k)[0][lo : lo + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out)


def write_files(docs: DataFrame, out_dir: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, length: int = LENGTH) -> list[dict]:
    """Writes the files and returns one manifest entry per file, in id order: path, base (ids before it), n_ids, n_docs.

    There is a file for FILE_BYTES of text, or one a core; the manifest has a row for each. Ties of id are ordered by a hash of the text."""
    path = path or vocabulary_path()
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    fs, root = pafs.FileSystem.from_uri(out_dir)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        K.tenant("op6", load.cache_clear)
        model, pid = load(path), TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(out_dir)
        name = f"{root}/part-{pid:06d}-{uuid.uuid4().hex}"
        writer = doc_file = None
        n_docs = 0
        with_seq = with_doc = None
        for b in K.pieces(batches, text_col, PIECE_BYTES):
            if writer is None:
                with_seq, with_doc = fs.open_output_stream(name + ".seq.arrow"), fs.open_output_stream(name + ".doc.arrow")
                writer, doc_file = SequenceWriter(with_seq, model.dtype, length), pa.ipc.new_file(with_doc, _DOCS)
            flat, starts = encode_texts(model, K.blobs(b.column(text_col)))
            n = np.diff(starts) + 1
            first = writer.n + np.cumsum(n) - n
            writer.write(np.insert(flat, starts[1:], model.dtype(end_id)))
            doc_file.write_batch(pa.RecordBatch.from_arrays([b.column(id_col).cast(pa.int64()), pa.array(first), pa.array(n)], schema=_DOCS))
            n_docs += len(n)
        if writer is not None:
            writer.close(), doc_file.close(), with_seq.close(), with_doc.close()
            yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int64()), "name": [name.rsplit("/", 1)[1]], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([writer.n], pa.int64())})

    ordered = docs.select(F.col(id_col), F.col(text_col)).repartitionByRange(parts, F.col(id_col)).sortWithinPartitions(F.col(id_col), F.xxhash64(F.col(text_col)))
    rows = sorted(ordered.mapInArrow(run, "pid long, name string, n_docs long, n_ids long").collect())
    out, base = [], 0
    for r in rows:
        out.append({"name": r["name"], "base": base, "n_ids": r["n_ids"], "n_docs": r["n_docs"]})
        base += r["n_ids"]
    return out


def _mapped(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder; local files are opened as memory maps."""
    fs, root = pafs.FileSystem.from_uri(uri)
    return (pafs.LocalFileSystem(use_mmap=True) if isinstance(fs, pafs.LocalFileSystem) else fs), root


def read_files(spark: SparkSession, out_dir: str, manifest: list[dict]) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _mapped(out_dir)
        for b in batches:
            for entry in b.to_pylist():
                at = f"{root}/{entry['name']}"
                with fs.open_input_file(at + ".seq.arrow") as seq, fs.open_input_file(at + ".doc.arrow") as doc:
                    reader, docs = SequenceReader(seq), pa.ipc.open_file(doc)
                    for k in range(docs.num_record_batches):
                        d = docs.get_batch(k)
                        crc = [zlib.crc32(reader.slice(s, n).astype("<u4").tobytes()) for s, n in zip(d.column(1).to_pylist(), d.column(2).to_pylist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([d.column(0), pa.array(d.column(1).to_numpy() + entry["base"]), d.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = [(m["name"], m["base"]) for m in manifest]
    return spark.createDataFrame(rows, "name string, base long").repartition(len(rows)).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs' files to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32.

    A null text counts as empty (the end id alone); a null id comes first; repeated rows are each
    written; an empty table gives no files and no rows; other columns are not read."""
    spark = docs.sparkSession
    out_dir = fresh_path(spark, "token-files")
    return read_files(spark, out_dir, write_files(docs, out_dir, path, id_col, text_col))
