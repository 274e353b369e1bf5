"""Language-model scoring with a weighted backoff automaton of trigrams.

Model, with c the counts of the training texts and a begin before each text:
P1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), P2(w | v) = (c(v, w) + m2 P1(w)) / (c(v) + m2),
P3(w | u, v) = (c(u, v, w) + m3 P2(w | v)) / (c(u, v) + m3) (Dirichlet smoothing: every P sums to one).

As an automaton: a state for each context seen in training, of two words, of one, and the root. A state has an arc
for each n-gram that goes on from it in training, with the log of its probability; the arc leads to the longest
context that its words end in. From a state of two words a failure arc with log m3 / (c(u, v) + m3) leads to
that of the second word, from there one with log m2 / (c(v) + m2) to the root, whose arcs take every token. So an n-gram
that training lacks costs the failure arcs on its way and the arc where the chain ends: exactly P3.

The traversal goes from left to right through all texts of a chunk in step, carrying each one's state. A text of more
than LANE tokens goes on in a further lane, which begins in the very state that the traversal has there (the longest
context seen in training of the two words before), so its sum is that of one traversal.

Counts come from all training documents. A run of rows asks for the counts of its distinct words, bigrams and
trigrams (see chunks); with the answers its part of the automaton is built and run. Words go by 63-bit hashes,
bigrams and trigrams by 50 bits of one: two of 10^9 share one with probability 10^-6 each, which moves a score, but no
count of words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.llm import chunks as C
from cairnspark.llm import textkernel as K
from cairnspark.llm.shared import drop_staged, forget_shuffles, staged

#: m2 and m3: the best of a few pairs by held-out probability at sf0.1.
SMOOTHING = (1000.0, 10.0)
CHUNK_BYTES = 4 << 20
#: Tokens that one lane of the traversal takes.
LANE = 1024
_END, _BEGIN = np.uint64(0x5D1E2A77C0FFEE01), np.uint64(0x3B9F00D15EA5E002)
_ODD, _ODD3 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_BITS = 50
_KINDS = (63, _BITS, _BITS)  # bits of the keys of words, bigrams, trigrams


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def token_stream(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens, an end after each text, and where each text begins (one more at the end)."""
    h, at = K.word_stream(texts, K.NONSPACE)
    return np.insert(h, at[1:], _END), at + np.arange(len(at))


def before(h: np.ndarray, at: np.ndarray, first) -> np.ndarray:
    """What is before each place within its text; first where a text begins."""
    out = np.empty_like(h)
    out[1:] = h[:-1]
    out[at[:-1]] = first
    return out


def ngram_streams(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Keys of the word, the bigram and the trigram that end at each place. A text's first token has the bigram of the
    begin, and no trigram of its own: its key is that of the bigram's, told apart."""
    two = K.mix(before(h, at, _BEGIN) * _ODD + h)
    three = K.mix(before(two, at, _BEGIN) * _ODD3 + h)
    cut = np.uint64(64 - _BITS)
    return [h >> np.uint64(1), two >> cut, three >> cut]


def distinct(h: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (of 63 bits or fewer) and the training count of each: one sort, the mark in the lowest bit."""
    marked = np.sort((h << np.uint64(1)) | training)
    keys = marked >> np.uint64(1)
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[new], np.add.reduceat((marked & np.uint64(1)).astype(np.int64), new) if len(new) else np.empty(0, np.int64)


class Automaton:
    """The part of the automaton that a run's tokens can reach.

    States: 0 to W - 1 are the words in order of their hashes, W the begin, W + 1 the root, from W + 2 on the
    bigrams seen in training, in order of their keys."""

    def __init__(self, streams: list[np.ndarray], at: np.ndarray, counts: list[np.ndarray], n_begin: int, total: int, vocabulary: int, smoothing: tuple[float, float]):
        """counts: of the sorted distinct keys of each stream, in training."""
        (m2, m3), (c1, c2, c3) = smoothing, counts
        n_words = len(c1)
        self.begin, self.root = n_words, n_words + 1
        self.words = K.numbered(streams[0])[2]
        _, i2, two = K.numbered(streams[1])  # i2: a place of each distinct bigram
        i3 = K.numbered(streams[2])[1]
        p1 = (c1 + 0.5) / (total + 0.5 * (vocabulary + 1))
        self.root_arc = np.log10(p1)
        # contexts
        number = np.cumsum(c2 > 0) - 1 + n_words + 2
        self.context1 = np.where(c1 > 0, np.arange(n_words), self.root)
        self.start = self.begin if n_begin else self.root
        last = before(self.words, at, n_words)
        one = np.append(self.context1, self.start)  # the context of one word, or the begin
        self.longest = np.where(c2[two] > 0, number[two], self.context1[self.words])  # the state after each place
        # arcs from contexts of one word, and of two: one for each n-gram of training
        own = np.append(c1.astype(np.float64), n_begin)
        w2, v2 = self.words[i2], last[i2]
        p2 = (c2 + m2 * p1[w2]) / (own[v2] + m2)
        has2 = c2 > 0
        begins = np.zeros(len(two), bool)
        begins[at[:-1]] = True
        behind = before(two, at, 0)[i3]
        has3 = (c3 > 0) & ~begins[i3] & (c2[behind] > 0)
        i3, behind = i3[has3], behind[has3]
        p3 = (c3[has3] + m3 * p2[two[i3]]) / (c2[behind] + m3)
        state = np.concatenate([one[v2[has2]], number[behind]])
        self.arcs = K.Table((state << 32) | np.concatenate([w2[has2], self.words[i3]]))
        self.weight = np.log10(np.concatenate([p2[has2], p3]))
        self.next = np.concatenate([self.longest[i2][has2], self.longest[i3]])
        # failure arcs
        kept = np.flatnonzero(has2)
        self.fail = np.concatenate([np.log10(m2 / (own + m2)), [0.0], np.log10(m3 / (c2[kept] + m3))])
        self.back = np.concatenate([np.full(n_words + 1, self.root), [self.root], self.context1[w2[kept]]])

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each lane adds, and its state after the word."""
        cost, out = np.zeros(len(state)), np.empty_like(state)
        todo = np.arange(len(state))
        while len(todo):
            s, w = state[todo], word[todo]
            i = self.arcs.find((s << 32) | w)
            has = i >= 0
            hit, i = todo[has], i[has]
            cost[hit] += self.weight[i]
            out[hit] = self.next[i]
            end = ~has & (s == self.root)
            cost[todo[end]] += self.root_arc[w[end]]
            out[todo[end]] = self.context1[w[end]]
            todo = todo[~has & ~end]
            cost[todo] += self.fail[state[todo]]
            state = state.copy()
            state[todo] = self.back[state[todo]]
        return cost, out

    def run(self, at: np.ndarray) -> np.ndarray:
        """Summed log10 probabilities of the texts."""
        n = np.diff(at)
        lanes = -(-n // LANE)
        text = np.repeat(np.arange(len(n)), lanes)
        k = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        pos = at[:-1][text] + k * LANE
        left = np.minimum(LANE, at[1:][text] - pos)
        state = np.where(k == 0, self.start, self.longest[np.maximum(pos - 1, 0)])
        order = np.argsort(-left, kind="stable")
        pos, left, state, text = pos[order], left[order], state[order], text[order]
        total = np.zeros(len(text))
        alive = np.searchsorted(-left, -np.arange(LANE), "left")  # lanes with more than t tokens
        for t in range(int(left[0]) if len(left) else 0):
            a = int(alive[t])
            cost, state[:a] = self.step(state[:a], self.words[pos[:a] + t])
            total[:a] += cost
        return np.bincount(text, total, len(n))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", smoothing: tuple[float, float] = SMOOTHING) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(id as text) mod 5 isn't 1, and from rows without an id. A null text
    counts as empty: its one token is the end. Repeated rows each count and are each scored.
    Without training rows N = V = 0 and every token has probability 1. An empty table gives no rows. Other columns are not read."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    text_bytes = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    ranges = C.ranges_of(text_bytes)
    edges = [np.array([(k << bits) // ranges for k in range(ranges)], np.uint64) for bits in _KINDS]
    texts = C.tagged(rows, CHUNK_BYTES, text_bytes)
    cell = ["k1", "c1", "k2", "c2", "k3", "c3"]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in C.runs(batches):
            h, at = token_stream(K.blobs(run["t"]))
            training = np.repeat([not held_out(i) for i in run["doc_id"].to_pylist()], np.diff(at))
            keys, counts = zip(*(distinct(x, training) for x in ngram_streams(h, at)), strict=True)
            out = []
            for head, cut in C.cells(run, keys, edges):
                packed = []
                for kind, (k, n, s) in enumerate(zip(keys, counts, cut, strict=True)):
                    packed += [C.packed_keys(k[s] - edges[kind][head[0]]), C.packed_counts(n[s])]
                out.append((*head, *packed))
            kinds = [pa.int64()] * 4 + [pa.binary()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["r", "chunk", "row", "rows", *cell])

    def summed(group: pa.Table) -> pa.Table:
        K.release()
        out, once = group.select(["chunk", "row", "rows", "r"]), {}
        for k, c in (("k1", "c1"), ("k2", "c2"), ("k3", "c3")):
            counts = [C.unpacked_counts(x) for x in group[c].to_pylist()]
            keys = [C.unpacked_keys(x, len(n)) for x, n in zip(group[k].to_pylist(), counts, strict=True)]
            answers, uniq, total = C.summed(keys, counts)
            out = out.append_column(c, pa.array([C.packed_counts(x) for x in answers], pa.binary()))
            if k == "k1":
                once = {"total": total.sum(), "words": (total > 0).sum(), "ends": total[uniq + edges[0][group["r"][0].as_py()] == _END >> np.uint64(1)].sum()}
        for name, x in once.items():
            out = out.append_column(name, pa.array(np.append(x, np.zeros(group.num_rows - 1)).astype(np.int64)))
        return out

    asking = texts.mapInArrow(asked, "r long, chunk long, row long, rows long, " + ", ".join(f"{c} binary" for c in cell))
    counted = asking.groupBy("r").applyInArrow(summed, "chunk long, row long, rows long, r long, c1 binary, c2 binary, c3 binary, total long, words long, ends long")
    answers = staged(counted, "lm-counts")
    del asking, counted
    forget_shuffles(docs.sparkSession)
    total, vocabulary, n_begin = (x or 0 for x in answers.agg(F.sum("total"), F.sum("words"), F.sum("ends")).first())

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        K.tenant("op5")
        K.release()
        return pa.concat_tables([score_run(*x) for x in C.answered(left, right)])

    def score_run(run: pa.Table, cells: pa.Table) -> pa.Table:
        h, at = token_stream(K.blobs(run["t"]))
        streams = ngram_streams(h, at)
        counts = [np.concatenate([C.unpacked_counts(x) for x in cells[c].to_pylist()]) for c in ("c1", "c2", "c3")]
        machine = Automaton(streams, at, counts, n_begin, total, vocabulary, smoothing)
        base = np.add.reduceat(machine.root_arc[machine.words], at[:-1])
        known = K.sums_by_text(counts[0][machine.words] > 0, at)
        return pa.table({"doc_id": run["doc_id"], "n_tokens": np.diff(at), "n_known": known, "base_score": base, "score": machine.run(at)})

    met = texts.groupBy("chunk").cogroup(answers.select("chunk", "row", "rows", "r", "c1", "c2", "c3").groupBy("chunk"))
    found = staged(met.applyInArrow(scored, "doc_id long, n_tokens long, n_known long, base_score double, score double"), "lm-scores", text_bytes // 16)
    drop_staged(texts, answers)
    return found.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
