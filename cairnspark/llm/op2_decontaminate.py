"""Benchmark decontamination with suffix arrays over the training texts.

The test set is cut into blocks of bounded size; each block's vocabulary numbers the words.
Every shard of training text (a piece of a partition) becomes a stream of word numbers and
gets a suffix array, sorted to window depth, of the suffixes that begin with the first words
of some test window (others match none). Every test suffix that starts a window is then
binary-searched in every shard: its range in the array is all its verbatim occurrences, which are never paired with equal
windows. The longest verbatim match comes from matching statistics on the suffix array of the words that windows cover.

What is broadcast is a group of test blocks: word numbers and vocabulary, GROUP_BYTES at most or one item,
however long that is; the windows are cut from them where they are searched. Then nothing is shuffled. A larger test set
takes a pass a group, each staged, and its broadcast released, before the next: a pass leaves hash, hits and items of
the texts hit, once for all copies of a text; these are merged by hash and joined with hashes and counts of all rows.
Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm import prefilter
from cairnspark.llm import suffixes as S
from cairnspark.llm import textkernel as K
from cairnspark.llm.shared import drop_staged, staged

WINDOW = 13
#: A document is contaminated if it has a hit and 1 of so many of its words is hit.
SHARE = 20
#: Pairs made at once.
_STEP = 1 << 20
#: Bytes of test text in a block, and of blocks in a broadcast, beyond a first item.
BLOCK_BYTES, GROUP_BYTES = 2 << 20, 8 << 20


@dataclass
class Windows:
    grid: np.ndarray  # (n, window) word numbers, 0 beyond a short window's end
    sizes: np.ndarray
    items: np.ndarray  # of each window: place in names
    at: np.ndarray  # of each window: place of its first word among the items' words, with one more place after each item


@dataclass
class Block:
    vocabulary: np.ndarray  # sorted word hashes; a word's number is its place + 1
    ids: np.ndarray  # word numbers of all items end to end
    starts: np.ndarray  # where each item begins (one more at the end)
    names: list[str]

    @classmethod
    def build(cls, names: list[str], texts: list[bytes | None]) -> Block:
        h, at = K.word_stream(texts, K.ALNUM)
        vocabulary, ids = np.unique(h, return_inverse=True)
        return cls(vocabulary, (ids + 1).astype(np.int32), at, names)

    @property
    def nbytes(self) -> int:
        return self.vocabulary.nbytes + self.ids.nbytes + self.starts.nbytes

    @property
    def bits(self) -> int:
        """Bits of a word number: any vocabulary has room."""
        return max(1, len(self.vocabulary).bit_length())

    def windows(self, window: int) -> Windows:
        n = np.diff(self.starts)
        ids = np.append(self.ids, np.zeros(window, np.int32))
        count = np.where(n == 0, 0, np.maximum(1, n - window + 1))
        items = np.repeat(np.arange(len(n)), count)
        first = np.repeat(self.starts[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        sizes = np.minimum(n, window)[items]
        grid = ids[first[:, None] + np.arange(window)] if len(first) else np.zeros((0, window), np.int32)
        grid = np.where(np.arange(window) < sizes[:, None], grid, np.int32(0))
        return Windows(grid, sizes, items, first + items)


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """The test set block by block; the driver holds one block's texts at a time."""
    names, texts, size = [], [], 0
    for row in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        t = (row[1] or "").encode()
        if names and size + len(t) > BLOCK_BYTES:
            yield Block.build(names, texts)
            names, texts, size = [], [], 0
        names.append("null" if row[0] is None else row[0])
        texts.append(t)
        size += len(t) + 1
    if names:
        yield Block.build(names, texts)


def groups(of: Iterator[Block]) -> Iterator[tuple[list[Block], bool]]:
    """Blocks in groups of bounded size, and whether a group is the last; one empty group of none."""
    held, size = [], 0
    for b in of:
        if held and size + b.nbytes > GROUP_BYTES:
            yield held, False
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    yield held, True


def _keys(grid: np.ndarray, bits: int) -> list[np.ndarray]:
    """Columns of word numbers packed as many to a key as fit 64 bits, the first highest."""
    width, per = grid.shape[1], 64 // bits
    out = []
    for c in range(0, width, per):
        k = np.zeros(len(grid), np.uint64)
        for j in range(per):
            k = (k << np.uint64(bits)) | (grid[:, c + j].astype(np.uint64) if c + j < width else np.uint64(0))
        out.append(k)
    return out


def _bound(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of every query in its own range of a column sorted within that range."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        v = column[np.minimum(mid, len(column) - 1)]
        up = open_ & ((v <= q) if right else (v < q))
        lo[up] = mid[up] + 1
        down = open_ & ~up
        hi[down] = mid[down]
    return lo


def suffix_array(stream: np.ndarray, positions: np.ndarray, depth: int, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """positions ordered by the depth words from there on, and the keys in that order."""
    padded = np.append(stream, np.zeros(depth, stream.dtype))
    keys = _keys(padded[positions[:, None] + np.arange(depth)], bits)
    order = np.lexsort(keys[::-1])
    return positions[order], [k[order] for k in keys]


def search(keys: list[np.ndarray], windows: Windows, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window's range in the suffix array."""
    n, per = len(keys[0]), 64 // bits
    lo, hi = np.zeros(len(windows.sizes), np.int64), np.full(len(windows.sizes), n, np.int64)
    for c, q in enumerate(_keys(windows.grid, bits)):
        left = np.clip(windows.sizes - c * per, 0, per)  # words of the window within this key
        free = ((per - left) * bits).astype(np.uint64)
        top = q | np.where(free < 64, (np.uint64(1) << np.minimum(free, np.uint64(63))) - np.uint64(1), ~np.uint64(0))
        lo, hi = _bound(keys[c], lo, hi, q, False), _bound(keys[c], lo, hi, top, True)
    return lo, hi


#: Minus the words of a match, its place in the text, the item, the place in the item (places in words); the least is the longest.
Match = tuple[int, int, str, int]
_MATCH = pa.struct([("n", pa.int64()), ("at", pa.int64()), ("item", pa.string()), ("item_at", pa.int64())])


def match_shard(hashes: np.ndarray, at: np.ndarray, block: Block, window: int) -> tuple[np.ndarray, np.ndarray, dict[int, Match]]:
    """Words hit, (text, item) pairs of occurring windows, and the longest match of each text that has one."""
    n_texts = len(at) - 1
    hit = np.zeros(len(hashes), bool)
    none = hit, np.empty((0, 2), np.int64), {}
    if not len(block.ids) or not len(hashes):
        return none
    v, bits, windows = block.vocabulary, block.bits, block.windows(window)
    filt = np.zeros(1 << 16, bool)
    filt[v >> np.uint64(48)] = True
    ids = np.zeros(len(hashes), np.int64)
    maybe = np.flatnonzero(filt[hashes >> np.uint64(48)])
    k = np.minimum(np.searchsorted(v, hashes[maybe]), len(v) - 1)
    ids[maybe] = np.where(v[k] == hashes[maybe], k + 1, 0)
    stream = np.insert(ids, at[1:], 0)  # a zero after each text: no match goes past it
    lead = min(3, 64 // bits, int(windows.sizes.min()))
    grams = np.unique(_keys(windows.grid[:, :lead], bits)[0])
    start = np.flatnonzero(stream)
    if lead > 1:
        tail = np.append(stream, np.zeros(lead, np.int64))
        start = start[(tail[start + 1] > 0) & (tail[start + lead - 1] > 0)]
        g = _keys(tail[start[:, None] + np.arange(lead)], bits)[0]
    else:
        g = _keys(stream[start][:, None], bits)[0]
    k = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
    start = start[grams[k] == g]
    if not len(start):
        return none
    array, keys = suffix_array(stream, start, window, bits)
    lo, hi = search(keys, windows, bits)
    w = np.flatnonzero(hi > lo)
    if not len(w):
        return none
    ends = at[1:] + np.arange(n_texts)  # the zero after each text
    # equal windows have one range in the array; ranges of windows of one size are disjoint
    _, one, same = K.numbered(lo[w] * (window + 1) + windows.sizes[w])
    lo, hi, sizes = lo[w[one]], hi[w[one]], windows.sizes[w[one]]
    edge, met, places = np.zeros(len(stream) + 1, np.int64), [], {}
    for m in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == m)
        count = hi[of] - lo[of]
        place = array[np.repeat(lo[of] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        edge[place] += 1
        edge[place + m] -= 1
        places[m] = place, np.repeat(of, count)
        met.append(K.counted(np.searchsorted(ends, place) * len(one) + places[m][1])[0])
    real = np.ones(len(stream), bool)
    real[ends] = False
    hit = (np.cumsum(edge)[:-1] > 0)[real]
    has = K.counted(same * len(block.names) + windows.items[w])[0]  # (window, item)
    pairs = _items(np.concatenate(met), has // len(block.names), has % len(block.names), len(one), len(block.names))
    longest = _longest_short(places, window, ends, at, has, block)
    if window in places:
        edge = np.bincount(places[window][0], minlength=len(stream) + 1) - np.bincount(places[window][0] + window, minlength=len(stream) + 1)
        full = w[windows.sizes[w] == window]
        full = windows.at[full] - windows.items[full]
        own = np.bincount(full, minlength=len(block.ids) + 1) - np.bincount(full + window, minlength=len(block.ids) + 1)
        longest |= _longest(stream, np.cumsum(edge)[:-1] > 0, ends, at, block, np.cumsum(own)[:-1] > 0, window)
    return hit, pairs, longest


def _items(met: np.ndarray, window: np.ndarray, item: np.ndarray, n_windows: int, n_items: int) -> np.ndarray:
    """met: text * n_windows + window; and which items each window has. Out: distinct (text, item). Windows of the same items are taken once a text."""
    begin = np.searchsorted(window, np.arange(n_windows + 1))
    sums = np.append(np.uint64(0), np.cumsum(K.mix(item.astype(np.uint64) + np.uint64(1)), dtype=np.uint64))
    _, first, alike = K.numbered(sums[begin[1:]] - sums[begin[:-1]])
    sets = K.counted(met // n_windows * n_windows + first[alike[met % n_windows]])[0]
    text, of = sets // n_windows, sets % n_windows
    upto, out = np.append(0, np.cumsum(begin[of + 1] - begin[of])), []
    for k in range(0, int(upto[-1]), _STEP):
        n = np.arange(k, min(k + _STEP, int(upto[-1])))
        row = np.searchsorted(upto, n, "right") - 1
        out.append(K.counted(text[row] * n_items + item[begin[of[row]] + n - upto[row]])[0])
    pairs = K.counted(np.concatenate(out))[0]
    return np.stack([pairs // n_items, pairs % n_items], 1)


def _longest_short(places: dict, window: int, ends: np.ndarray, at: np.ndarray, has: np.ndarray, block: Block) -> dict[int, Match]:
    """The longest item of fewer words than a window that each text has."""
    short = [m for m in places if m < window]
    if not short:
        return {}
    names, rank = np.unique(block.names, return_inverse=True)
    least = np.full(int(has.max()) // len(block.names) + 1, len(names))
    np.minimum.at(least, has // len(block.names), rank[has % len(block.names)])
    place, item, size = (np.concatenate(x) for x in zip(*((places[m][0], least[places[m][1]], np.full(len(places[m][0]), m)) for m in short), strict=True))
    text = np.searchsorted(ends, place)
    order = np.lexsort((item, place, -size, text))
    order = order[np.append(True, np.diff(text[order]) != 0)]
    columns = (x[order].tolist() for x in (text, size, place - (at[text] + text), item))
    return {i: (-n, s, str(names[k]), 0) for i, n, s, k in zip(*columns, strict=True)}


def _longest(stream: np.ndarray, covered: np.ndarray, ends: np.ndarray, at: np.ndarray, block: Block, own: np.ndarray, window: int) -> dict[int, Match]:
    """The longest match of each text that has a whole window: matching statistics on the suffix array of what windows cover of
    the items (own) and of the texts. What a suffix of a text shares with items it shares most with the nearest of theirs on either side."""
    b, t = np.flatnonzero(own), np.flatnonzero(covered)
    item = np.searchsorted(block.starts, b, "right") - 1
    fresh = np.concatenate([[True], (np.diff(b) > 1) | (np.diff(item) > 0), [True], np.diff(t) > 1])
    mark = np.flatnonzero(fresh)
    apart = len(block.vocabulary) + 1 + np.arange(len(mark) + 1)
    s = np.append(np.insert(np.concatenate([block.ids[b].astype(np.int64), stream[t]]), mark, apart[:-1]), apart[-1])
    word = np.append(np.insert(np.arange(len(b) + len(t)), mark, -1), -1)  # of each number, its word among b and t
    order = S.suffix_array(s)
    lcp = S.common_prefixes(s, order)
    n, src = len(order), word[order]
    ours, theirs = (src >= 0) & (src < len(b)), src >= len(b)

    def shared(v: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The least of v since the last stop, 0 before the first."""
        part = np.cumsum(stops)
        low = np.minimum.accumulate(np.where(stops, n, v) - part * (n + 2)) + part * (n + 2)
        return np.where(part > 0, low, 0)

    most = np.maximum(shared(lcp[:n], ours), shared(lcp[1:][::-1], ours[::-1])[::-1])
    slot = np.flatnonzero(theirs & (most >= window))
    place = t[src[slot] - len(b)]
    text = np.searchsorted(ends, place)
    pick = np.lexsort((place, -most[slot], text))
    pick = pick[np.append(True, np.diff(text[pick]) != 0)]
    slot, place, text = slot[pick], place[pick], text[pick]
    size = most[slot]
    lo, hi = slot.copy(), slot + 1
    before, after = S.smaller_before(lcp[:n]), n - S.smaller_before(lcp[::-1])[::-1]
    while (far := lcp[lo] >= size).any():
        lo[far] = before[lo[far]]
    while (far := lcp[hi] >= size).any():
        hi[far] = after[hi[far]]
    names, rank = np.unique(block.names, return_inverse=True)
    span = len(block.ids) + 1
    key = np.full(n + 1, np.iinfo(np.int64).max)
    of = item[src[:n][ours]]
    key[:n][ours] = rank[of] * span + b[src[ours]] - block.starts[of]
    least = np.minimum.reduceat(key, np.stack([lo, hi], 1).ravel())[::2]
    columns = (x.tolist() for x in (text, size, place - (at[text] + text), least // span, least % span))
    return {i: (-m, p, str(names[k]), o) for i, m, p, k, o in zip(*columns, strict=True)}


_HITS = "text_md5 binary, hits binary, items array<string>, longest struct<n: bigint, at: bigint, item: string, item_at: bigint>"
_OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_item string, longest_at long, longest_item_at long"


def _matched(texts: list[bytes | None], group: list[Block], window: int) -> tuple[np.ndarray, np.ndarray, list[set[str]], list[Match | None]]:
    """Where each text's words begin, the words hit, and each text's items and longest match."""
    hashes, at = K.word_stream(texts, K.ALNUM)
    hit, longest = np.zeros(len(hashes), bool), [None] * len(texts)
    items: list[set[str]] = [set() for _ in texts]
    for block in group:
        h, pairs, far = match_shard(hashes, at, block, window)
        hit |= h
        for t, m in far.items():
            longest[t] = min(longest[t] or m, m)
        for t, i in pairs.tolist():
            items[t].add(block.names[i])
    return at, hit, items, longest


def _report(ids: pa.Array, n_words: np.ndarray, n_hit: np.ndarray, items: list, longest: list[Match | None], share: int) -> pa.RecordBatch:
    number = lambda x: pa.array(x, pa.int64())
    sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
    far = [pa.array([m and m[k] for m in longest], kind) for k, kind in ((2, pa.string()), (1, pa.int64()), (3, pa.int64()))]
    columns = [ids.cast(pa.int64()), number(n_words), number(n_hit), number([len(x) for x in items]), pa.array(sha, pa.string()), pa.array(_bad(n_words, n_hit, share)), number([-m[0] if m else 0 for m in longest]), *far]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _OUT.split(", ")])


def _bad(n_words: np.ndarray, n_hit: np.ndarray, share: int) -> np.ndarray:
    return (n_hit > 0) & (share * n_hit >= n_words)


def _hits_of(docs: DataFrame, text_col: str, group, window: int) -> DataFrame:
    """Of each text hit by a group: its hash, the words hit as bits, items and longest match. Copies of a text have one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.tenant("op2")
        for b in K.pieces(batches, "t"):
            at, hit, items, longest = _matched(K.blobs(b.column(0)), group.value, window)
            some = [k for k, x in enumerate(items) if x]
            bits = [np.packbits(hit[at[k] : at[k + 1]]).tobytes() for k in some]
            far = [dict(zip(("n", "at", "item", "item_at"), longest[k], strict=True)) for k in some]
            columns = [b.column(1).take(pa.array(some, pa.int64())), pa.array(bits, pa.binary()), pa.array([sorted(items[k]) for k in some], pa.list_(pa.string())), pa.array(far, _MATCH)]
            yield pa.RecordBatch.from_arrays(columns, names=["text_md5", "hits", "items", "longest"])

    rows = docs.select(F.col(f"`{text_col}`").alias("t"), F.unhex(F.md5(F.col(f"`{text_col}`").cast("binary"))).alias("text_md5")).filter("t IS NOT NULL")
    return rows.mapInArrow(run, _HITS).dropDuplicates(["text_md5"])


def _merged(group: pa.Table) -> pa.Table:
    """One text's rows, one for each group of blocks that hit it, as one."""
    width = max(len(x) for x in group["hits"].to_pylist())
    bits = np.zeros(width, np.uint8)
    for x in group["hits"].to_pylist():
        bits |= np.frombuffer(x, np.uint8)
    items = sorted({i for x in group["items"].to_pylist() for i in x})
    longest = min(tuple(x.values()) for x in group["longest"].to_pylist())
    far = dict(zip(("n", "at", "item", "item_at"), longest, strict=True))
    return pa.table({"text_md5": group["text_md5"].slice(0, 1), "n_hit": pa.array([int(np.unpackbits(bits).sum())], pa.int64()), "items": pa.array([items], pa.list_(pa.string())), "longest": pa.array([far], _MATCH)})


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = SHARE, keep_columns: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and of the longest verbatim match (the first of several; none: 0 and nulls)
    its words, its item and the words before it in the text and in the item: longest, longest_item, longest_at, longest_item_at.

    With keep_columns, instead the rows of docs that aren't contaminated, as they are. A null or
    empty text has no words and is clean; items without words have no windows; an empty test set
    hits nothing; repeated rows are each judged; columns beside the two named are not looked at, and
    those named __cairn_* raise."""
    spark = docs.sparkSession
    if any(x.startswith("__cairn_") for x in docs.columns):
        raise ValueError("columns named __cairn_* are taken")
    several = []
    for group, last in groups(blocks(benchmark, item_col, item_text)):
        sent = spark.sparkContext.broadcast(group)
        if last and not several:
            return _in_one_pass(docs, sent, id_col, text_col, window, share, keep_columns)
        several.append(staged(_hits_of(docs, text_col, sent, window), "hits"))
        sent.unpersist(True)
    every = several[0]
    for x in several[1:]:
        every = every.unionByName(x)
    merged = staged(every.groupBy("text_md5").applyInArrow(_merged, _HITS.replace("hits binary", "n_hit long")), "hits")
    drop_staged(*several)
    names = [id_col, text_col]
    md5 = F.unhex(F.md5(F.col(f"`{text_col}`").cast("binary")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.tenant("op2")
        for b in K.pieces(batches, text_col):
            n_words = np.diff(K.word_stream(K.blobs(b.column(1)), K.ALNUM)[1])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n_words, pa.int64()), b.column(2)], names=["doc_id", "n_words", "text_md5"])

    def reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            longest = [x and tuple(x.values()) for x in b.column(4).to_pylist()]
            n = [b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2)]
            yield _report(b.column(0), *n, [x or [] for x in b.column(3).to_pylist()], longest, share)

    words = docs.select(*[F.col(f"`{x}`") for x in names], md5.alias("__cairn_md5")).mapInArrow(counted, "doc_id long, n_words long, text_md5 binary")
    if keep_columns:
        bad = words.join(merged.select("text_md5", "n_hit"), "text_md5").filter((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
        return prefilter.without(docs, md5, staged(bad.select("text_md5").distinct(), "contaminated"))
    met = words.join(merged, "text_md5", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")), "items", "longest")
    return met.mapInArrow(reported, _OUT)


def _in_one_pass(docs: DataFrame, group, id_col: str, text_col: str, window: int, share: int, keep_columns: bool) -> DataFrame:
    names = docs.columns if keep_columns else [id_col, text_col]
    text_at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.tenant("op2")
        for b in K.pieces(batches, text_col):
            at, hit, items, longest = _matched(K.blobs(b.column(text_at)), group.value, window)
            n_words, n_hit = np.diff(at), K.sums_by_text(hit, at)
            if keep_columns:
                yield b.filter(pa.array(~_bad(n_words, n_hit, share)))
            else:
                yield _report(b.column(0), n_words, n_hit, items, longest, share)

    return docs.select(*[F.col(f"`{x}`") for x in names]).mapInArrow(run, docs.schema if keep_columns else _OUT)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(13, len(w)) AS m, unnest(generate_series(1, greatest(1, len(w) - 12))) AS s FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS g FROM bs),
ms AS (SELECT DISTINCT m FROM bg),
ds AS (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s FROM d, ms WHERE len(w) >= m),
dg AS (SELECT doc_id, m, s, array_to_string(list_slice(w, s, s + m - 1), ' ') AS g FROM ds),
o AS (SELECT dg.doc_id, dg.s, dg.m, bg.item_id FROM dg JOIN bg ON dg.m = bg.m AND dg.g = bg.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + m - 1)) AS p FROM o) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
