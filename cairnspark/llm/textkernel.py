"""Vectorised byte kernels shared by the text operators.

Texts of a record batch are laid end to end in one byte buffer with a newline between
documents; words are found and hashed with whole-array numpy operations, so no operator
loops over words in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that an operator handles at once; one longer text makes a longer piece.
PIECE_BYTES = 4 << 20
_BLOCK = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)

#: ASCII upper case to lower case; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of letters, digits and non-ASCII characters, after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Everything but ASCII white space.
NONSPACE = np.ones(256, bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        _pow = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _P)]))
        _inv = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _PINV)]))
    return _pow, _inv


def segment_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], sorted disjoint segments; equal bytes hash equally."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _BLOCK, "right")))
        hi = int(ends[j - 1])
        p, q = _powers(hi - lo)
        c = np.empty(hi - lo + 1, np.uint64)
        c[0] = 0
        np.cumsum(_BYTE[buf[lo:hi]] * p[: hi - lo], out=c[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (c[e] - c[s]) * q[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def words(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the table marks."""
    w = table[buf].view(np.int8)
    d = np.diff(w, prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def lay(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a newline after each text, and each text's start (one more at the end)."""
    texts = [t or b"" for t in texts]
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), at


def word_stream(texts: list[bytes | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, and the words before each text (one more at the end)."""
    buf, at = lay(texts)
    buf = LOWER[buf]
    s, e = words(buf, table)
    return segment_hashes(buf, s, e), np.searchsorted(s, at)


def blobs(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column's UTF-8 bytes."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


_tenant, _held = "", {}


def tenant(name: str, forget=None) -> None:
    """Says whose work a Python worker begins. Workers live through many stages: what another operator has kept
    in this one (vocabularies, models, words) is forgotten first. forget: how this one's is."""
    global _tenant
    if name != _tenant:
        for f in _held.values():
            f()
        _held.clear()
        _tenant = name
        release()
    if forget:
        _held[name] = forget


def release() -> None:
    """Gives memory that a worker no longer uses back to the system; workers live through many stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces(batches: Iterable[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about limit bytes of text at most; nothing is cut within a row."""
    import pyarrow.compute as pc

    release()
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield b.slice(lo, hi - lo)
        release()
    release()


def sums_by_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]]."""
    c = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=c[1:])
    return c[at[1:]] - c[at[:-1]]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys and how often each comes."""
    ascending = np.sort(keys)
    new = np.flatnonzero(np.append(True, ascending[1:] != ascending[:-1])) if len(keys) else np.empty(0, np.int64)
    return ascending[new], np.diff(np.append(new, len(keys)))


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, a place of each, and each key's number among them. Sorting and scattering back is several
    times faster here than searching every key."""
    order = np.argsort(keys)
    ascending = keys[order]
    new = np.append(True, ascending[1:] != ascending[:-1]) if len(keys) else np.empty(0, bool)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return ascending[new], order[new], number


class Table:
    """Distinct keys of 63 bits or fewer -> their place: one look-up by hash, a search only where several share a slot."""

    def __init__(self, keys: np.ndarray):
        bits = max(8, int(len(keys)).bit_length() + 2)
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int32)
        slot = self._slot(keys)
        self.slots[slot] = np.arange(len(keys), dtype=np.int32)
        rest = np.flatnonzero(self.slots[slot] != np.arange(len(keys)))
        rest = rest[np.argsort(keys[rest])]
        self.more, self.more_at = keys[rest], rest
        self.crowded = np.zeros(1 << bits, bool)
        self.crowded[slot[rest]] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _P) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        slot = self._slot(keys)
        at = self.slots[slot]
        out = np.where(self.keys[at] == keys, at, -1).astype(np.int64)
        miss = np.flatnonzero((out < 0) & self.crowded[slot])
        if len(miss):
            k = np.minimum(np.searchsorted(self.more, keys[miss]), len(self.more) - 1)
            hit = self.more[k] == keys[miss]
            out[miss[hit]] = self.more_at[k[hit]]
        return out
