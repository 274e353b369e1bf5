"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters 8 bytes wide run over the whole document (stride 2); their
rectified responses are averaged in chunks of 128 bytes that overlap by half; a second layer of
learned filters reads each chunk; its responses are max-pooled over all chunks and combined into
one probability. The gradient reaches only the chunks that won the pooling.

The network is fitted on the driver from a bounded sample of labelled rows: SAMPLE_ROWS rows at
most, chosen by a hash of the id, of those whose text has at most SAMPLE_BYTES bytes. Scoring is
narrow and reads every byte of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.llm import textkernel as K

SAMPLE_ROWS = 2000
SAMPLE_BYTES = 32 << 10
THRESHOLD = 0.3
EPOCHS = 10
_EMBED, _WIDE, _STRIDE, _FILTERS, _SECOND = 8, 8, 2, 32, 24
_HALF = 64  # bytes of half a chunk
_BLOCK = 1 << 14


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one buffer, each padded with zeros to whole half chunks and past its last filter, and then by a half chunk that
    belongs to none: the filters at a text's end must not see the next one."""
    n = np.array([-(-(len(t) + _WIDE) // _HALF) + 1 for t in texts], np.int64)
    at = np.append(0, np.cumsum(n))
    buf = np.zeros(int(at[-1]) * _HALF + _WIDE, np.uint8)
    for t, k in zip(texts, at[:-1].tolist(), strict=True):
        buf[k * _HALF : k * _HALF + len(t)] = np.frombuffer(t, np.uint8)
    return buf, at


@dataclass
class Network:
    p: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        g = np.random.default_rng(seed)
        f = np.float32
        return cls({
            "embed": g.normal(0, 0.5, (256, _EMBED)).astype(f),
            "w1": g.normal(0, (2 / (_EMBED * _WIDE)) ** 0.5, (_EMBED * _WIDE, _FILTERS)).astype(f),
            "b1": np.zeros(_FILTERS, f),
            "w2": g.normal(0, (2 / _FILTERS) ** 0.5 * 2, (_FILTERS, _SECOND)).astype(f),
            "b2": np.zeros(_SECOND, f),
            "w3": g.normal(0, 0.3, _SECOND).astype(f),
            "b3": np.zeros(1, f),
        })

    def _windows(self, buf: np.ndarray) -> np.ndarray:
        """(positions, bytes under the filter) of whole half chunks; buf has _WIDE bytes more."""
        x = self.p["embed"][buf]
        n = (len(buf) - _WIDE) // _STRIDE
        s = x.strides[0]
        return np.lib.stride_tricks.as_strided(x, (n, _WIDE * _EMBED), (s * _STRIDE, x.strides[1])).copy()

    def halves(self, buf: np.ndarray) -> np.ndarray:
        """Mean rectified responses of each half chunk."""
        out = []
        for i in range(0, len(buf) - _WIDE, _BLOCK):
            part = buf[i : min(len(buf), i + _BLOCK + _WIDE)]
            a = self._windows(part) @ self.p["w1"]
            a += self.p["b1"]
            np.maximum(a, 0, out=a)
            out.append(a.reshape(-1, _HALF // _STRIDE, _FILTERS).mean(1))
        return np.concatenate(out)

    @staticmethod
    def chunks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each chunk's first and second half, and the chunks before each text; one half alone is a chunk. The last half of
        a text's layout is none."""
        n = np.diff(at) - 1
        count = np.maximum(1, n - 1)
        start = np.append(0, np.cumsum(count))
        first = np.repeat(at[:-1] - start[:-1], count) + np.arange(start[-1])
        return first, np.where(np.repeat(n, count) > 1, first + 1, first), start

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        buf, at = _layout(texts)
        h = self.halves(buf)
        first, second, start = self.chunks(at)
        z = np.maximum(((h[first] + h[second]) / 2) @ self.p["w2"] + self.p["b2"], 0)
        top = np.maximum.reduceat(z, start[:-1])
        return 1 / (1 + np.exp(-np.clip((top @ self.p["w3"]).astype(np.float64) + float(self.p["b3"][0]), -30, 30)))

    def gradient(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        buf, at = _layout(texts)
        h = self.halves(buf)
        first, second, start = self.chunks(at)
        c = (h[first] + h[second]) / 2
        z = np.maximum(c @ p["w2"] + p["b2"], 0)
        win = np.stack([lo + z[lo:hi].argmax(0) for lo, hi in zip(start[:-1], start[1:], strict=True)])
        top = np.take_along_axis(z, win, 0)
        d = ((1 / (1 + np.exp(-np.clip(top @ p["w3"] + p["b3"], -30, 30)))) - y).astype(np.float32) / len(y)
        g = {"w3": top.T @ d, "b3": np.array([d.sum()], np.float32)}
        dtop = d[:, None] * p["w3"] * (top > 0)
        own, place = np.unique(win, return_inverse=True)
        dz = np.zeros((len(own), _SECOND), np.float32)
        np.add.at(dz, (place.reshape(win.shape), np.arange(_SECOND)), dtop)
        g["w2"], g["b2"] = c[own].T @ dz, dz.sum(0)
        dc = dz @ p["w2"].T / 2
        parts, where = np.unique(np.concatenate([first[own], second[own]]), return_inverse=True)
        dh = np.zeros((len(parts), _FILTERS), np.float32)
        np.add.at(dh, where, np.concatenate([dc, dc]))
        per = _HALF // _STRIDE
        raw = buf[parts[:, None] * _HALF + np.arange(_HALF + _WIDE)]
        under = raw[:, np.arange(per)[:, None] * _STRIDE + np.arange(_WIDE)].reshape(-1, _WIDE)
        x = p["embed"][under].reshape(-1, _WIDE * _EMBED)
        da = np.repeat(dh / per, per, 0) * (x @ p["w1"] + p["b1"] > 0)
        g["w1"], g["b1"] = x.T @ da, da.sum(0)
        dx = (da @ p["w1"].T).reshape(-1, _EMBED)
        g["embed"] = np.stack([np.bincount(under.ravel(), dx[:, k], 256) for k in range(_EMBED)], 1).astype(np.float32)
        return g


def fit(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, batch: int = 48, rate: float = 0.006, seed: int = 7) -> Network:
    """Adam on the log loss. With one class only, a network that always gives that class's rate."""
    if not len(y) or y.min() == y.max():
        return Network(constant=float(y[0]) if len(y) else 1.0)
    net, g = Network.fresh(seed), np.random.default_rng(seed)
    net.p["b3"][:] = np.log(y.mean() / (1 - y.mean()))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step, total = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = g.permutation(len(y))
        for i in range(0, len(y), batch):
            own = order[i : i + batch]
            step += 1
            lr = rate * (1 - step / (total + 1)) * (1 - 0.9**step) ** -1 * (1 - 0.999**step) ** 0.5
            for k, d in net.gradient([texts[j] for j in own], y[own]).items():
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                net.p[k] = net.p[k] - (lr * m[k] / (np.sqrt(v[k]) + 1e-7)).astype(np.float32)
    return net


def remainder(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """Fits on labelled rows that aren't held out; contradicting labels of an id count as 0, null ones as none."""
    marked = labels.filter(F.col(label_col).isNotNull() & (remainder("doc_id") != 0)).groupBy("doc_id").agg(F.min(label_col).alias("y"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).withColumnRenamed("doc_id", "i")
    rows = (
        docs.select(F.col(f"`{id_col}`").alias("i"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
        .filter(F.octet_length("t") <= SAMPLE_BYTES)
        .join(F.broadcast(chosen), "i")  # at most SAMPLE_ROWS ids
        .select("i", "t", "y")
        .orderBy(F.xxhash64("i"), "i", F.xxhash64("t"))
        .limit(SAMPLE_ROWS)
        .collect()
    )
    return fit([r["t"].encode() for r in rows], np.array([r["y"] for r in rows], np.float32))


def _scores(net: Network, batch: pa.RecordBatch, column: int) -> np.ndarray:
    return net.score([t or b"" for t in K.blobs(batch.column(column))])


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Null counts as empty; a null id is not held out; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.tenant("op1")
        for b in K.pieces(batches, text_col):
            s = _scores(net, b, 2)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(remainder(id_col) == 0, F.lit(False)).alias("held_out"), F.col(f"`{text_col}`").alias(text_col))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, net: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows with a score of threshold or more, as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.tenant("op1")
        for b in K.pieces(batches, text_col):
            yield b.filter(pa.array(_scores(net, b, at) >= threshold))

    return docs.mapInArrow(run, docs.schema)
