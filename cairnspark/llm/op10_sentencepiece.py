"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut before runs of spaces and around line breaks (no piece of the vocabulary
reaches over such a cut; that is proved when the model is loaded, and cuts that pieces
cross are not made). Each distinct word of a batch is merged once, in flat numpy arrays
(see mergerounds), and texts are put together from their words' results.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm import textkernel as K
from cairnspark.llm.mergerounds import Pairs, merge_words

MODEL = "piece_bpe_32k.model"
_SPACE = "▁"
#: Distinct words that a Python worker remembers from one batch to the next (those that came
#: more than once); beyond that it forgets all and starts again.
WORDS_KEPT = 1 << 15
#: Bytes of text merged at once.
PIECE_BYTES = 3 << 19


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceModel:
    """Tables made from a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        ids = {self.pieces[i]: i for i in plain}
        self.base = n  # symbols from here on are characters: base + code point

        def symbol(s: str) -> int | None:
            return ids.get(s, self.base + ord(s) if len(s) == 1 else None)

        scores = sorted({sp.get_score(i) for i in plain}, reverse=True)
        dense = {x: k for k, x in enumerate(scores)}
        left, right, rank, merged = [], [], [], []
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                a, b = symbol(piece[:k]), symbol(piece[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(dense[sp.get_score(i)]), merged.append(i)
        owners = np.bincount([dense[sp.get_score(i)] for i in plain])
        self.pairs = Pairs(left, right, rank, merged, tied=np.flatnonzero(owners > 1).tolist())
        self.char_ids = {ord(p): i for p, i in ids.items() if len(p) == 1}
        self.char_table = np.full(0x110000, -1, np.int32)
        self.char_table[list(self.char_ids)] = list(self.char_ids.values())
        if any(_SPACE in p.lstrip(_SPACE) for p in ids):
            raise ValueError("a piece holds a space after another character: words can't be cut at spaces")
        self.cut_lines = not any("\n" in p for p in ids)
        self.decimal = [b"%d" % i for i in range(n)]
        self.outputs: list[bytes] = []
        for i in range(n):
            if sp.is_byte(i):
                self.outputs.append(bytes([int(self.pieces[i][3:5], 16)]))
            elif i in self.control:
                self.outputs.append(b"")
            elif i == self.unknown:
                self.outputs.append(" ⁇ ".encode())
            else:
                self.outputs.append(self.pieces[i].replace(_SPACE, " ").encode())

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, whose spaces are written as ASCII spaces, and each word's count."""
        chars = np.frombuffer(b"".join(words).replace(b" ", _SPACE.encode()).decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        lead = np.frombuffer(b"".join(words), np.uint8)
        at = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(w) for w in words], out=at[1:])
        lengths = K.sums_by_text((lead & 0xC0) != 0x80, at)
        sym = self.char_table[chars]
        sym = np.where(sym < 0, self.base + chars, sym)
        out, counts = merge_words(sym, lengths, self.pairs)
        raw = np.flatnonzero(out >= self.base)
        if len(raw):  # characters without a piece become their bytes
            spelt = [self.byte_ids[list(chr(x).encode())] for x in (out[raw] - self.base).tolist()]
            width = np.ones(len(out), np.int64)
            width[raw] = [len(x) for x in spelt]
            ends = np.cumsum(counts)
            at = np.append(0, np.cumsum(width))
            out = np.repeat(out, width)
            for i, x in zip(raw.tolist(), spelt, strict=True):
                out[at[i] : at[i] + len(x)] = x
            counts = np.diff(at[np.append(0, ends)])
        return out, counts

    def raw_decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.outputs[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes that aren't UTF-8 become U+FFFD, the first space goes."""
        while ids and ids[0] in self.control:
            ids = ids[1:]
        out = self.raw_decode(ids)
        return out[out[:1] == b" " :].decode("utf-8", "replace")


@functools.lru_cache(2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


_known: dict[str, dict[bytes, tuple[int, bytes, bytes]]] = {}


def _forget() -> None:
    load.cache_clear()
    _known.clear()


def encode_texts(model: PieceModel, path: str, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list]:
    """Word codes of all texts, the words before each text, and (count, ids as text, decoded) by code."""
    kept = _known.setdefault(path, {})
    filled = [b" " + t.replace(_SPACE.encode(), b" ") if t else b"" for t in texts]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in filled], out=at[1:])
    whole = b"".join(filled)
    buf = np.frombuffer(whole, np.uint8)
    if not len(buf):
        return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64), []
    space = buf == 32
    cut = space & np.append(True, ~space[:-1])
    if model.cut_lines:
        line = buf == 10
        cut |= line & np.append(True, ~line[:-1])
        cut[1:] |= line[:-1] & ~line[1:]
    cut[at[:-1][np.diff(at) > 0]] = True
    s = np.flatnonzero(cut)
    e = np.append(s[1:], len(buf))
    _, first, codes = K.numbered(K.segment_hashes(buf, s, e))
    words = [whole[a:b] for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)]
    results = list(map(kept.get, words))
    missing = [k for k, r in enumerate(results) if r is None]
    if missing:
        ids, counts = model.encode_words([words[k] for k in missing])
        ends = np.cumsum(counts).tolist()
        ids = ids.tolist()
        decimal, plain = [model.decimal[i] for i in ids], [model.outputs[i] for i in ids]
        lo = 0
        for k, hi in zip(missing, ends, strict=True):
            results[k] = (hi - lo, b",".join(decimal[lo:hi]), b"".join(plain[lo:hi]))
            lo = hi
        often = np.bincount(codes) > 1
        again = {words[k]: results[k] for k in missing if often[k]}
        if len(kept) + len(again) > WORDS_KEPT:
            kept.clear()
        kept.update(again)
    return codes, np.searchsorted(s, at), results


def digest(batch: pa.RecordBatch, path: str, id_col: str, text_col: str) -> pa.RecordBatch:
    model = load(path)
    codes, at, results = encode_texts(model, path, K.blobs(batch.column(text_col)))
    counts = np.array([r[0] for r in results], np.int64)
    n = K.sums_by_text(counts[codes], at) if len(results) else np.zeros(batch.num_rows, np.int64)
    codes, id_text, plain = codes.tolist(), [r[1] for r in results], [r[2] for r in results]
    ids_sha, text_sha = [], []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = codes[lo:hi]
        ids_sha.append(hashlib.sha256(b",".join([id_text[c] for c in own])).hexdigest())
        out = b"".join([plain[c] for c in own])
        out = out[out[:1] == b" " :]
        text_sha.append(hashlib.sha256(out.decode("utf-8", "replace").encode()).hexdigest())
    return pa.RecordBatch.from_arrays(
        [batch.column(id_col).cast(pa.int64()), pa.array(n), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """Ids and decoded text of every row: id, ids array<int>, decoded string. Null and empty texts have no ids."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.tenant("op10", _forget)
        model = load(path)
        for b in K.pieces(batches, text_col, PIECE_BYTES):
            codes, at, results = encode_texts(model, path, K.blobs(b.column(text_col)))
            ids = [[int(x) for c in codes[lo:hi].tolist() for x in results[c][1].split(b",")] for lo, hi in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(id_col).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(x) for x in ids], pa.string())], names=[id_col, ids_col, decoded_col])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` long, `{ids_col}` array<int>, `{decoded_col}` string")


def encode_digest(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Narrow: no shuffle, nothing is sent to the driver. A null text counts as empty: no ids, and
    the digests are those of the empty string. A null id stays null; repeated rows are each
    encoded; other columns are not read."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.tenant("op10", _forget)
        for b in K.pieces(batches, text_col, PIECE_BYTES):
            yield digest(b, path, id_col, text_col)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
