"""Near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A document is its set of five-word shingles with weight (1 + log10 tf) (1 + log10(N / df)), df counted
over all documents for every shingle (see chunks: a frequent shingle costs a run of rows one key).

Documents with the same words are one node before anything else. Only texts that can be similar to another one
are sampled: those with enough of their weight in shingles that another text has too (see shareable; this loses
no pair). 100 samples in 20 bands of 5 give buckets. In each bucket all nodes are compared with the one that shares most buckets; their links
give components. Buckets that still hold several components are cut into blocks. Two blocks meet
unless both hold only the bucket's largest component, first with their signatures alone: only nodes
that agree in 60 of 100 samples or more with one of another component are given their texts, and
those are compared, each pair in the first bucket that it shares. Every comparison is the exact weighted
Jaccard similarity of the whole texts. Blocks are bounded in nodes and in bytes of text, and only links
that join two components leave a task.

What the sampling misses: a pair at exactly 0.8 shares no bucket with probability 4e-4, and agrees in fewer than 60
samples with 2e-6; both fall fast above 0.8.

The samples' random numbers (r, c, beta of the method) come from hashes of shingle and sample, so each
shingle has its own whatever the text's length; ties fall to the shingle's own hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnspark.llm import chunks as C
from cairnspark.llm import prefilter
from cairnspark.llm import textkernel as K
from cairnspark.llm.components import components
from cairnspark.llm.shared import drop_staged, forget_shuffles, staged

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
#: Samples of 100 that must agree before a pair across components is compared: five deviations below 80.
AGREE = 60
#: Nodes of a bucket, and bytes of their texts, that one block has.
BLOCK, BLOCK_BYTES = 1024, 2 << 20
#: Bytes of text handled at once.
PIECE_BYTES = 3 << 20
_HASH_BITS = 50
#: Texts whose numbers fit above the hash, and one more.
_TEXTS = (1 << (64 - _HASH_BITS)) - 1
_CACHED = 1 << 16
_LOW = np.uint64(0xFFFFFFFF)
#: Type of a node: 126 bits of a hash of the word sequence (or of the bytes, without words).
_NODE = "decimal(38,0)"


def shingles(texts: list[bytes | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (50-bit hashes) by text, ascending; their counts; where each text begins; and two
    64-bit hashes of each text's word sequence (of its bytes, if it has no word). Any number of texts."""
    parts = [_shingles(texts[lo : lo + _TEXTS], size) for lo in range(0, max(1, len(texts)), _TEXTS)]
    if len(parts) == 1:
        return parts[0]
    keys, tf, starts, same = zip(*parts, strict=True)
    before = np.append(0, np.cumsum([len(k) for k in keys]))
    starts = [s[:-1] + b for s, b in zip(starts, before, strict=False)]
    return np.concatenate(keys), np.concatenate(tf), np.concatenate([*starts, before[-1:]]), np.concatenate(same)


def _shingles(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """shingles of at most _TEXTS texts: text and hash are one number, so one sort does."""
    h, at = K.word_stream(texts, K.ALNUM)
    n = np.diff(at)
    count = np.where(n == 0, 0, np.maximum(1, n - size + 1))
    text = np.repeat(np.arange(len(n)), count)
    first = np.repeat(at[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    width = np.minimum(n, size)[text]
    padded = np.append(h, np.zeros(size, np.uint64))
    key = np.zeros(len(first), np.uint64)
    for j in range(size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + np.where(j < width, padded[first + j], np.uint64(0))
    packed = np.sort((text.astype(np.uint64) << np.uint64(_HASH_BITS)) | (K.mix(key) >> np.uint64(64 - _HASH_BITS)))
    new = np.flatnonzero(np.append(True, packed[1:] != packed[:-1])) if len(packed) else np.empty(0, np.int64)
    tf = np.diff(np.append(new, len(packed)))
    packed = packed[new]
    starts = np.searchsorted(packed, np.arange(len(n) + 1, dtype=np.uint64) << np.uint64(_HASH_BITS))
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(at[:-1], n).astype(np.uint64)
    same = np.zeros((len(n), 2), np.uint64)
    for k, odd in enumerate((0xA24BAED4963EE407, 0x9FB21C651E98DF25)):
        v = np.append(np.uint64(0), np.cumsum(K.mix(h + place * np.uint64(odd)), dtype=np.uint64))
        same[:, k] = K.mix(v[at[1:]] - v[at[:-1]] + n.astype(np.uint64))
    bare = np.flatnonzero(n == 0)
    if len(bare):
        buf, lay = K.lay([texts[i] for i in bare.tolist()])
        for k in range(2):
            same[bare, k] = K.segment_hashes(buf, lay[:-1], lay[1:]) + np.uint64(k + 1)
    return packed & np.uint64((1 << _HASH_BITS) - 1), tf, starts, same


def weights(tf: np.ndarray, df: np.ndarray, total: int) -> np.ndarray:
    """TF-IDF weights of shingles from how often they are in their text, and in how many of all texts."""
    return (1 + np.log10(tf)) * (1 + np.log10(total / df))


def shareable(w: np.ndarray, df: np.ndarray, starts: np.ndarray, threshold: float) -> np.ndarray:
    """Which texts can be similar to any other. What two texts have in common is in both of them, so in shingles of two
    texts or more, and weighs no more than those do in either: if they are less than threshold of a text's weight, so is
    its similarity to every other text. (The margin is for sums of floats.)"""
    whole, common = K.sums_by_text(w, starts), K.sums_by_text(np.where(df > 1, w, 0.0), starts)
    return (np.diff(starts) > 0) & (common >= (threshold - 1e-6) * whole)


@lru_cache(1)
def _seeds(samples: int) -> np.ndarray:
    """Three odd multipliers for each sample."""
    return np.random.Generator(np.random.PCG64(97)).integers(1, 1 << 63, (samples, 3), dtype=np.uint64) | np.uint64(1)


def _hashed(s: np.ndarray, odd: np.uint64) -> np.ndarray:
    h = s * odd
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def _product(half: np.ndarray) -> np.ndarray:
    """Of 32-bit numbers, the upper 16 bits times the lower 16."""
    p = half >> np.uint32(16)
    p *= half & np.uint32(0xFFFF)
    return p.astype(np.float32)


def _ordered(a: np.ndarray) -> np.ndarray:
    """32-bit numbers in the order of the values."""
    bits = np.asarray(a, np.float32).view(np.uint32)
    return np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)


def _packed(ln_w, r, ln_c, beta) -> np.ndarray:
    """The sample's value for weights w as a sortable 32-bit number, over a mark of the level t."""
    t = np.floor(ln_w / r + beta)
    return (_ordered(ln_c - r * (t - beta) - r) << np.uint64(32)) | ((t.astype(np.int64) * 0x9E3779B1).astype(np.uint64) & _LOW)


def _least(s: np.ndarray, ln_w: np.ndarray, h: np.ndarray, u: np.ndarray, odd: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """The least key that each text has among these shingles, all ones where it has none of them."""
    out = np.full(texts, ~np.uint64(0))
    if len(s):
        f = _hashed(s, odd[1])  # further bits of u1 and u2, and beta
        u1 = (h >> np.uint64(48)).astype(np.float32) + ((f >> np.uint64(48)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-16)
        u2 = (h >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.float32) + ((f >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-16)
        r = np.maximum(-np.log(u1 * u2 * np.float32(2.0**-32)), np.float32(1e-7))
        beta = (_hashed(s, odd[2]) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        key = _packed(ln_w, r, np.log(-np.log(u * np.float32(2.0**-32))), beta) ^ (s & _LOW)
        new = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        out[text[new]] = np.minimum.reduceat(key, new)
    return out


def signatures(s: np.ndarray, w: np.ndarray, starts: np.ndarray, samples: int = BANDS * ROWS) -> np.ndarray:
    """A row of 32-bit samples for each text; every text must have a shingle.

    Of a 64-bit hash, 16 bits each go to the four uniform numbers of c = -ln(u3 u4) and of e^-r = u1 u2 (Gamma(2, 1) both).
    A shingle's value a lies between c e^-r / w and c / w, so a is computed only for shingles whose lower bound is at most
    the least upper bound of their text. The least a of a text is exponential with the sum of its weights as rate: at
    first shingles up to five times its mean are tried, and the rest for texts whose least a turns out above that."""
    best = np.full((samples, len(starts) - 1), ~np.uint64(0))
    for lo in range(0, len(s), _CACHED):  # as many shingles as fit a processor's cache, whole texts or not
        own, weight = s[lo : lo + _CACHED], w[lo : lo + _CACHED]
        inverse, ln_w = (-1 / weight).astype(np.float32), np.log(weight).astype(np.float32)
        first = int(np.searchsorted(starts, lo, "right")) - 1
        last = int(np.searchsorted(starts, lo + len(own), "left"))
        n = last - first
        cut = np.maximum(starts[first:last] - lo, 0)
        length = np.diff(np.append(cut, len(own)))
        text = np.repeat(np.arange(n), length)
        usual = (5 / np.add.reduceat(weight, cut)).astype(np.float32)
        usual_key = _ordered(np.log(usual))
        bound = np.repeat(usual * np.float32(2.0**32), length)  # e below lacks the factor 2**-32
        for k, odd in enumerate(_seeds(samples)):
            h = _hashed(own, odd[0])
            h |= np.uint64(0x10001)  # u3 and u4 are middles of 2**15 parts
            halves = h.view(np.uint32)
            e, u = _product(halves[1::2]), _product(halves[::2])
            top = np.log(u * np.float32(2.0**-32))
            top *= inverse
            e *= top
            i = np.flatnonzero(e <= bound)
            least = _least(own[i], ln_w[i], h[i], u[i], odd, text[i], n)
            late = (least >> np.uint64(32)) >= usual_key
            if late.any():
                limit = np.where(late, np.minimum.reduceat(top, cut) * np.float32(2.0**32 * 1.001), np.float32(-1))
                i = np.flatnonzero(e <= limit[text])
                least = np.minimum(least, _least(own[i], ln_w[i], h[i], u[i], odd, text[i], n))
            best[k, first:last] = np.minimum(best[k, first:last], least)
    return np.ascontiguousarray((best & _LOW).astype(np.uint32).T)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - common
    return float(common / total) if total else 0.0


def document_frequencies(texts: DataFrame, size: int, text_bytes: int) -> DataFrame:
    """texts: chunk, row, t and more. Out: chunk, row, rows, r, df (packed): in how many documents each distinct
    shingle of a run of rows is, for a range of hashes, in the order of the hashes."""
    ranges = C.ranges_of(text_bytes)
    edges = np.array([(k << _HASH_BITS) // ranges for k in range(ranges)], np.uint64)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in C.runs(batches):
            keys, n = K.counted(shingles(K.blobs(run["t"]), size)[0])
            out = [(*head, C.packed_keys(keys[s] - edges[head[0]]), C.packed_counts(n[s])) for head, (s,) in C.cells(run, [keys], [edges])]
            kinds = [pa.int64()] * 4 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["r", "chunk", "row", "rows", "s", "n"])

    def summed(group: pa.Table) -> pa.Table:
        counts = [C.unpacked_counts(x) for x in group["n"].to_pylist()]
        keys = [C.unpacked_keys(x, len(n)) for x, n in zip(group["s"].to_pylist(), counts, strict=True)]
        answers = [C.packed_counts(x) for x in C.summed(keys, counts)[0]]
        return group.select(["chunk", "row", "rows", "r"]).append_column("df", pa.array(answers, pa.binary()))

    cells = texts.select("chunk", "row", "t").mapInArrow(asked, "r long, chunk long, row long, rows long, s binary, n binary")
    return staged(cells.groupBy("r").applyInArrow(summed, "chunk long, row long, rows long, r long, df binary"), "shingles")


def _nodes(same: np.ndarray) -> pa.Array:
    """128-bit hashes as decimals of 126 bits, never negative."""
    raw = same.copy()
    raw[:, 1] &= np.uint64((1 << 62) - 1)
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw).tobytes())])


def _binaries(rows: np.ndarray, has: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values, empty ones where a row hasn't any."""
    width = rows.shape[1] * rows.itemsize
    at = np.append(0, np.cumsum(np.where(has, width, 0))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(rows[has]).tobytes())])


def _bands(sig: Column) -> Column:
    """A bucket for each band of a signature."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(sig, k * (4 * ROWS) + 1, F.lit(4 * ROWS))))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows come sorted by their first columns; the rows of one key at a time."""
    held, now = [], None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(i).to_numpy() for i in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if now is not None and now != tuple(key[lo]):
                yield pa.Table.from_batches(held)
                held = []
            now = tuple(key[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


class _Block:
    """Nodes of two blocks of a bucket, with the pairs that are to be looked at."""

    def __init__(self, t: pa.Table):
        self.k, self.root = t["k"][0].as_py(), np.unique(np.array(t["root"].to_pylist(), object), return_inverse=True)[1]
        self.side, self.split = t["side"].to_numpy(), t["p1"][0].as_py() != t["p2"][0].as_py()
        self.sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(t.num_rows, BANDS * ROWS)

    def partners(self, i: int) -> np.ndarray:
        """Nodes after i, of another component, that agree with it in AGREE samples and in no band before this one."""
        j = np.arange(i + 1, len(self.side))
        j = j[(self.root[j] != self.root[i]) & ((self.side[j] != self.side[i]) | (not self.split))]
        if not len(j):
            return j
        same = self.sig[j] == self.sig[i]
        ok = same.sum(1) >= AGREE
        ok &= ~same[:, : self.k * ROWS].reshape(len(j), self.k, ROWS).all(2).any(1)
        return j[ok]


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = SIMILARITY) -> DataFrame:
    """Per row: doc_id, class_id (the least id of its class), kept (whether doc_id is that), text_md5.

    Texts with the same words are similar; texts without words only to the same bytes. A text of
    fewer words than a shingle is one shingle. A null text counts as empty. A row without an id is in no class
    (class_id null) and kept. Rows are told apart by id and text: rows that share an id but not a text may be in
    different classes, and repeated rows are in one. An empty table gives no rows. Other columns are not read."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("t"))
    known = rows.filter("doc_id IS NOT NULL").withColumn("text_md5", F.unhex(F.md5(F.col("t").cast("binary"))))
    total, text_bytes = (x or 0 for x in known.agg(F.count(F.lit(1)), F.sum(F.octet_length("t"))).first())
    ids = text_bytes // 4  # bytes of a table of ids, roughly
    texts = C.tagged(known, PIECE_BYTES, text_bytes)
    answers = document_frequencies(texts, size, text_bytes)
    forget_shuffles(spark)

    def sign(left: pa.Table, right: pa.Table) -> pa.Table:
        K.tenant("op3")
        K.release()
        return pa.concat_tables([signed_run(*x) for x in C.answered(left, right)])

    def signed_run(run: pa.Table, cells: pa.Table) -> pa.Table:
        s, tf, starts, same = shingles(K.blobs(run["t"]), size)
        df = np.concatenate([C.unpacked_counts(x) for x in cells["df"].to_pylist()])
        own = df[K.numbered(s)[2]]
        w = weights(tf, own, total)
        has = shareable(w, own, starts, threshold)
        sig = np.zeros((run.num_rows, BANDS * ROWS), np.uint32)
        if has.any():
            length = np.diff(starts)
            some = np.repeat(has, length)
            sig[has] = signatures(s[some], w[some], np.append(0, np.cumsum(length[has])))
        counts = [C.packed_counts(own[p:q]) if x else b"" for p, q, x in zip(starts[:-1], starts[1:], has.tolist(), strict=True)]
        return pa.table({"doc_id": run["doc_id"], "row": run["row"], "node": _nodes(same), "sig": _binaries(sig, has), "text_md5": run["text_md5"], "df": pa.array(counts, pa.binary())})

    def weighted(texts: list[bytes | None], df: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        s, tf, starts, _ = shingles(texts, size)
        w = weights(tf, np.concatenate([C.unpacked_counts(x) for x in df]), total)
        return [(s[p:q], w[p:q]) for p, q in zip(starts[:-1], starts[1:], strict=True)]

    met = texts.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    signed = staged(met.applyInArrow(sign, f"doc_id long, row long, node {_NODE}, sig binary, text_md5 binary, df binary"), "signatures")
    drop_staged(answers)
    del met
    forget_shuffles(spark)
    copies = staged(signed.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "copies", ids)
    # a row a node: rows alone with their node stay where they are, of the others only the one that stands for it
    split = prefilter.marked(signed, F.col("node").cast("string"), staged(prefilter.bitmap(copies.select(F.col("node").cast("string").alias("node")), "node"), "bits", prefilter.BITS // 8))
    some = split.filter("__cairn_maybe").drop("__cairn_maybe")
    first = some.groupBy("node").agg(F.min("row").alias("row")).select("row")
    single = split.filter("NOT __cairn_maybe").drop("__cairn_maybe").unionByName(some.join(first.hint("shuffle_hash"), "row", "left_semi"))
    single = staged(single.select("node", "row", "sig", "df"), "singles")
    banded = single.filter(F.octet_length("sig") > 0).select("node", F.posexplode(_bands(F.col("sig"))).alias("k", "b"))
    shared = staged(banded.groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets", ids)
    every = staged(banded.join(shared.hint("shuffle_hash"), "b"), "members", ids)
    degree = staged(every.groupBy("node").agg(F.sum(F.col("n") - 1).alias("d")), "degrees", ids)
    # of buckets with the same members, the one of the first band speaks for all
    sets = every.groupBy("b").agg(F.first("k").alias("k"), F.first("n").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("x"))
    distinct = staged(sets.groupBy("n", "x").agg(F.min_by("b", "k").alias("b")).select("b"), "sets", ids)
    members = staged(every.join(distinct.hint("shuffle_hash"), "b", "left_semi"), "members", ids)
    ranked = members.join(degree, "node")
    heads = ranked.groupBy("b").agg(F.max(F.struct("d", (-F.col("node")).alias("i"))).alias("m")).select("b", (-F.col("m.i")).cast(_NODE).alias("head"))
    heads = staged(heads, "heads", ids)
    pairs = members.join(heads, "b").filter("node != head").select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b"))
    pairs = staged(pairs.distinct(), "pairs", ids)
    asked = staged(single.join(degree.select("node").hint("shuffle_hash"), "node", "left_semi").select("node", "row", "sig", "df"), "asked", ids)
    some = prefilter.marked(texts.select("row", "t"), F.col("row"), staged(prefilter.bitmap(asked, "row"), "bits", prefilter.BITS // 8))
    bodies = staged(some.filter("__cairn_maybe").select("row", "t").join(asked, "row").drop("row"), "texts")
    drop_staged(texts, asked)
    forget_shuffles(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, 256):
                    b = whole.slice(lo, 256)
                    ids = b.column(0).to_pylist(), b.column(1).to_pylist()
                    both = {i: (t, n) for i, t, n in zip(ids[0] + ids[1], K.blobs(b.column(2)) + K.blobs(b.column(3)), b.column(4).to_pylist() + b.column(5).to_pylist(), strict=True)}
                    sets = dict(zip(both, weighted(*map(list, zip(*both.values(), strict=True))), strict=True))
                    near = [similarity(sets[x], sets[y]) >= threshold - 1e-9 for x, y in zip(*ids, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(near))

        side = lambda x: bodies.select(F.col("node").alias(x), F.col("t").alias(f"t{x}"), F.col("df").alias(f"n{x}"))
        return staged(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb", "na", "nb").mapInArrow(run, f"a {_NODE}, b {_NODE}"), "links", ids)

    links = verified(pairs)
    roots = components(links, ids)
    placed = members.join(roots, members["node"] == roots["id"], "left").select("b", "k", members["node"], F.coalesce("root", members["node"]).alias("root"))
    mixed = staged(placed.groupBy("b").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("b"), "mixed", ids)
    rest = placed.join(mixed.hint("shuffle_hash"), "b", "left_semi").join(bodies.select("node", F.octet_length("t").alias("bytes")), "node")
    rest = staged(rest, "rest", ids)
    per = rest.groupBy("b", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("w"))
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / BLOCK_BYTES), F.lit(1)).cast("int")
    most = per.groupBy("b").agg(F.max(F.struct("n", "w", "root")).alias("m"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    cut = staged(most.select("b", F.col("m.root").alias("main"), blocks(F.col("m.n"), F.col("m.w")).alias("many"), blocks(F.col("n") - F.col("m.n"), F.col("w") - F.col("m.w")).alias("few")), "blocks", ids)
    own = F.xxhash64("node")
    p = F.when(F.col("root") == F.col("main"), F.col("few") + F.pmod(own, F.col("many"))).otherwise(F.pmod(own, F.col("few"))).cast("int")
    meets = F.when(F.col("root") == F.col("main"), F.col("few")).otherwise(F.col("few") + F.col("many"))
    spread = rest.join(cut.hint("shuffle_hash"), "b").select("b", "k", "node", "root", p.alias("side"), F.explode(F.sequence(F.lit(0), meets - 1)).alias("q"))
    spread = spread.select("b", F.least("side", "q").alias("p1"), F.greatest("side", "q").alias("p2"), "k", "side", "node", "root")
    block = ["b", "p1", "p2"]

    def in_blocks(df: DataFrame, run, schema: str) -> DataFrame:
        return df.repartition(*block).sortWithinPartitions(*block).mapInArrow(run, schema)

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 3):
            pairs, found = _Block(t), np.zeros(t.num_rows, bool)
            for i in range(t.num_rows - 1):
                j = pairs.partners(i)
                found[j] = True
                found[i] |= len(j) > 0
            yield from t.drop_columns(["sig"]).filter(pa.array(found)).to_batches()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 3):
            pairs, ids, out = _Block(t), t["node"].to_pylist(), []
            sets = weighted(K.blobs(t["t"]), t["df"].to_pylist())
            for i in range(len(ids) - 1):
                for x in pairs.partners(i).tolist():
                    if pairs.root[x] != pairs.root[i] and similarity(sets[i], sets[x]) >= threshold - 1e-9:
                        out.append((ids[i], ids[x]))
                        pairs.root[pairs.root == pairs.root[x]] = pairs.root[i]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.decimal128(38, 0)) for c in zip(*out, strict=True)], names=["a", "b"])

    columns = f"b long, p1 int, p2 int, k int, side int, node {_NODE}, root {_NODE}"
    marks = staged(in_blocks(spread.join(bodies.select("node", "sig"), "node").select(*block, "k", "side", "node", "root", "sig"), agreeing, columns), "marks", ids)
    if not marks.isEmpty():
        full = marks.join(bodies, "node").select(*block, "k", "side", "node", "root", "sig", "t", "df")
        more = staged(in_blocks(full, across, f"a {_NODE}, b {_NODE}"), "links", ids)
        drop_staged(roots)
        roots = components(links.unionByName(more), ids)
    rooted = signed.select("doc_id", "node", "text_md5").join(roots.withColumnRenamed("id", "node").hint("shuffle_hash"), "node", "left")
    rooted = staged(rooted.select("doc_id", "text_md5", F.coalesce("root", "node").alias("root")), "classed", ids)
    classes = staged(rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("root", "class_id"), "classes", ids)
    drop_staged(signed, single, copies, shared, every, degree, distinct, members, heads, pairs, bodies, links, roots, mixed, rest, cut, marks)
    out = rooted.join(classes.hint("shuffle_hash"), "root", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    out = out.select("doc_id", "class_id", (F.col("class_id") == F.col("doc_id")).alias("kept"), "text_md5")
    bare = docs.filter(F.col(f"`{id_col}`").cast("long").isNull())
    return out.unionByName(bare.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"), F.unhex(F.md5(text.cast("binary"))).alias("text_md5")))
