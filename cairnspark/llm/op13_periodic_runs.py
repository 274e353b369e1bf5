"""Periodic runs of words, by Stoye and Gusfield's search for branching tandem repeats on a suffix tree.

The words of a batch of texts become one stream of numbers with a separator of its own wherever texts
meet. Its suffix tree is the tree of lcp intervals of its suffix array: a node is an interval of suffixes, its
depth their common words, its leaf list the interval itself. For every node of depth D all children but
the largest are walked (the smaller halves: n log n leaves in all), and leaf i is paired with i + D and i - D:
if both are of the node and differ in what follows, the word pair at the smaller one is a tandem repeat that branches.

Such a repeat sits at the right end of a run of period D; turning it to the left, as long as the next word
agrees, finds the run's other end. A run's repeats whose period is a multiple of the run's own are merged into it.

Narrow: no shuffle, nothing goes to the driver. Before the tree is built, words that no run can hold are cut
out: in a run of 6 words or more and of 4 periods or more each five words come twice in their text. Arrays are
linear in the words of a batch (PIECE_BYTES of text, or one longer text); leaves are walked LEAVES at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm import suffixes as S
from cairnspark.llm import textkernel as K

#: A run has so many words at least, and so many periods.
WORDS, PERIODS = 6, 4
_GRAM = WORDS - 1
#: Leaves walked at once.
LEAVES = 1 << 20
PIECE_BYTES = 3 << 20


def repeats(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the branching tandem repeats that two more repeats of their word precede."""
    order = S.suffix_array(s)
    n, lcp = len(s), S.common_prefixes(s, order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    lo, hi = S.smaller_before(lcp), n - S.smaller_before(lcp[::-1])[::-1]
    cut = np.flatnonzero((lcp[:n] > 0) & (hi[:n] - lo[:n] >= PERIODS))  # where children of a node meet
    if not len(cut):
        return cut, cut
    cut = cut[np.lexsort((cut, hi[cut], lo[cut]))]
    first = np.flatnonzero(np.append(True, (np.diff(lo[cut]) != 0) | (np.diff(hi[cut]) != 0)))
    last = np.append(first[1:], len(cut)) - 1
    node = np.repeat(np.arange(len(first)), last - first + 1)
    begin = np.append(0, cut[:-1])
    begin[first] = lo[cut[first]]
    low, high, depth = lo[cut[first]], hi[cut[first]], lcp[cut[first]]
    begin, end, node = np.append(begin, cut[last]), np.append(cut, high), np.append(node, np.arange(len(first)))
    by = np.lexsort((begin - end, node))  # the largest child first
    begin, end, node = begin[by], end[by], node[by]
    small = np.append(False, node[1:] == node[:-1])
    begin, end, node = begin[small], end[small], node[small]
    upto = np.append(0, np.cumsum(end - begin))
    out = []
    for k in range(0, int(upto[-1]), LEAVES):
        leaf = np.arange(k, min(k + LEAVES, int(upto[-1])))
        child = np.searchsorted(upto, leaf, "right") - 1
        i, v = order[begin[child] + leaf - upto[child]], node[child]
        d = depth[v]
        i, d, v = np.append(i, i - d), np.append(d, d), np.append(v, v)  # the leaf is the repeat's first word or its second
        inside = i - 2 * d >= 0
        i, d, v = i[inside], d[inside], v[inside]
        for shift in (0, 1, -1, -2):
            at = i + shift * d
            ok = at < n
            at = place[np.minimum(at, n - 1)]
            ok &= (at >= low[v]) & (at < high[v])
            i, d, v = i[ok], d[ok], v[ok]
        branch = s[i + d] != s[i + 2 * d]
        out.append(np.unique(np.stack([i[branch], d[branch]], 1), axis=0))
    both = np.unique(np.concatenate(out), axis=0)
    return both[:, 0], both[:, 1]


def runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of the maximal runs of PERIODS periods or more in s, whose both ends are numbers that come once."""
    start, period = repeats(s)
    end = start + 2 * period
    by = np.lexsort((period, end))
    end, period = end[by], period[by]
    out = []
    while len(end):
        head = np.append(True, end[1:] != end[:-1])  # the least period of each end
        e, d = end[head], period[head]
        begin = e - 2 * d
        begin = begin - S.agreeing(s, begin - 1, begin + d - 1, -1)
        out.append((begin, e - begin, d))
        k = np.cumsum(head) - 1
        rest = ~head & ((period % d[k] != 0) | (end - 2 * period < begin[k]))
        end, period = end[rest], period[rest]
    if not out:
        return start, start, start
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _repeated(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words of runs of _GRAM words that come twice in their text."""
    n = np.diff(at)
    text = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    key, size = K.mix(text + np.uint64(1)), max(0, len(h) - _GRAM + 1)
    key = key[:size]
    for j in range(_GRAM):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[j : j + size]
    whole = np.flatnonzero(text[:size] == text[_GRAM - 1 :][:size])
    key = K.mix(key[whole])
    ascending, count = K.counted(key)
    often = ascending[count > 1]
    out = np.zeros(len(h) + 1, np.int64)
    if len(often):
        filt = np.zeros(1 << 16, bool)
        filt[often >> np.uint64(48)] = True
        maybe = np.flatnonzero(filt[key >> np.uint64(48)])
        hit = often[np.minimum(np.searchsorted(often, key[maybe]), len(often) - 1)] == key[maybe]
        first = whole[maybe[hit]]
        np.add.at(out, first, 1)
        np.add.at(out, first + _GRAM, -1)
    return np.cumsum(out)[:-1] > 0


def runs_of_texts(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows (text, start in the text, length, period) in that order. h: hashes of words; text k has those from at[k] on."""
    kept = np.flatnonzero(_repeated(h, at))
    if not len(kept):
        return np.empty((0, 4), np.int64)
    text = np.searchsorted(at, kept, "right") - 1
    _, number = np.unique(K.mix(h[kept] + text.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), return_inverse=True)
    fresh = np.append(True, (np.diff(kept) > 1) | (np.diff(text) > 0))
    mark = np.flatnonzero(fresh)
    apart = number.max() + 1 + np.arange(len(mark) + 1)
    s = np.append(np.insert(number, mark, apart[:-1]), apart[-1])
    start, length, period = runs(s)
    ok = length >= WORDS
    word = kept[start[ok] - np.searchsorted(mark + np.arange(len(mark)), start[ok])]
    text = np.searchsorted(at, word, "right") - 1
    out = np.stack([text, word - at[text], length[ok], period[ok]], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def plant(doc_id: int, n: int) -> np.ndarray:
    """For a tenth of the ids, numbers of the words that stand at each of n places once a run has been put in; else the places."""
    h = zlib.crc32(str(doc_id).encode())
    i = np.arange(n)
    if h % 10 or not n:
        return i
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(i < a, i, a + (i - a) % p)


_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """Per row: doc_id; n_runs; start, length, period and exponent_milli of the longest run (of several the first, then that of the
    least period; without a run nulls); runs, by start, then period; collapsed: the words without those that a run repeats, with single spaces.

    A run is a stretch of words with smallest period q, of 6 words and 4 q or more, that no neighbour extends. planted: puts runs
    into a tenth of the texts first (see plant), none where the id is null. A null or empty text, or one of white space, has no words: no
    run, collapsed is empty. Words are compared by 64-bit hashes of their bytes. Repeated rows are each judged; columns beside the two
    named are not read; an empty table gives no rows. One text's words are in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.tenant("op13")
        for b in K.pieces(batches, "t", PIECE_BYTES):
            ids, texts = b.column(0).to_pylist(), [t or b"" for t in K.blobs(b.column(1))]
            buf, lay = K.lay(texts)
            s, e = K.words(buf, K.NONSPACE)
            h, at = K.segment_hashes(buf, s, e), np.searchsorted(s, lay)
            moved = {}
            for k, i in enumerate(ids if planted else []):
                if i is not None and at[k + 1] > at[k] and zlib.crc32(str(i).encode()) % 10 == 0:
                    moved[k] = plant(i, int(at[k + 1] - at[k]))
                    h[at[k] : at[k + 1]] = h[at[k] + moved[k]]
            found = runs_of_texts(h, at)
            first = np.searchsorted(found[:, 0], np.arange(len(texts) + 1)).tolist()
            n, best, lists, collapsed = [], [], [], []
            for k, (lo, hi) in enumerate(zip(first, first[1:], strict=False)):
                own = found[lo:hi, 1:]
                words = texts[k].split()  # bytes: at ASCII white space
                if k in moved:
                    words = [words[x] for x in moved[k].tolist()]
                if hi > lo:
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, own[:, 0] + own[:, 2], 1)
                    np.add.at(gone, own[:, 0] + own[:, 1], -1)
                    words = [words[x] for x in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
                    best.append(own[np.lexsort((own[:, 2], own[:, 0], -own[:, 1]))[0]].tolist())
                else:
                    best.append([None] * 3)
                n.append(hi - lo)
                lists.append([dict(zip(("start", "length", "period"), x, strict=True)) for x in own.tolist()])
                collapsed.append(b" ".join(words))
            longest = [pa.array(x, pa.int64()) for x in zip(*best, strict=True)]
            milli = pa.array([None if x[0] is None else 1000 * x[1] // x[2] for x in best], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *longest, milli, pa.array(lists, pa.list_(_RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())], names=_NAMES)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return rows.mapInArrow(run, _SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """periodic_runs with runs and collapsed as digests."""
    line = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n")))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
