"""Byte-pair merging of many words at once by vectorised rounds.

All words' symbols lie in one flat array. Each round looks up the rank of every adjacent
pair, takes the minimum per word (a segmented reduction), merges that pair's leftmost
non-overlapping occurrences in all words simultaneously, and compacts the array; words
without a known pair leave. Rounds go on until no pair remains.

Merging several occurrences at once equals merging them one by one unless a pair that
arises on the way outranks the merged one. Words where that may happen are found exactly
and done again with one merge per round.
"""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Pairs:
    """(left, right) -> (rank, merged symbol), an open table with a sorted overflow.

    tied: ranks that belong to more than one pair's result (one merge per round then)."""

    def __init__(self, left, right, rank, merged, tied=()):
        key = (np.asarray(left, np.uint64) << np.uint64(32)) | np.asarray(right, np.uint64)
        bits = max(12, int(np.ceil(np.log2(max(1, len(key))))) + 3)
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.at = np.full(1 << bits, -1, np.int32)
        slot = (key * _ODD) >> self.shift
        _, first = np.unique(slot, return_index=True)
        self.keys[slot[first]], self.at[slot[first]] = key[first], first
        rest = np.setdiff1d(np.arange(len(key)), first)
        rest = rest[np.argsort(key[rest])]
        self.more, self.more_at = key[rest], rest.astype(np.int32)
        self.crowded = np.zeros(1 << bits, bool)
        self.crowded[slot[rest]] = True
        self.rank = np.append(np.asarray(rank, np.int32), NONE)
        self.merged = np.append(np.asarray(merged, np.int32), np.int32(-1))
        self.tied = np.asarray(sorted(tied), np.int32)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair, -1 if there is none."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = (key * _ODD) >> self.shift
        out = np.where(self.keys[slot] == key, self.at[slot], np.int32(-1))
        if len(self.more):
            miss = np.flatnonzero((out < 0) & self.crowded[slot])
            if len(miss):
                k = np.minimum(np.searchsorted(self.more, key[miss]), len(self.more) - 1)
                hit = self.more[k] == key[miss]
                out[miss[hit]] = self.more_at[k[hit]]
        return out


def merge_words(symbols: np.ndarray, lengths: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols of all words laid end to end, and each word's count. Empty words stay empty."""
    lengths = np.asarray(lengths, np.int64)
    done, redo = _rounds(symbols.astype(np.int32), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), pairs, False)
    if len(redo):
        again = np.isin(np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), redo)
        done += _rounds(symbols[again].astype(np.int32), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[again], pairs, True)[0]
    if not done:
        return np.empty(0, np.int32), np.zeros(len(lengths), np.int64)
    word = np.concatenate([w for _, w in done])
    order = np.argsort(word, kind="stable")
    return np.concatenate([s for s, _ in done])[order], np.bincount(word, minlength=len(lengths))


def _rounds(sym, word, pairs, strict):
    done, redo = [], []
    found = np.full(len(sym), -1, np.int32)
    if len(sym) > 1:
        same = word[1:] == word[:-1]
        found[:-1] = np.where(same, pairs.find(sym[:-1], sym[1:]), -1)
    while len(sym):
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        rank = pairs.rank[found]
        best = np.minimum.reduceat(rank, starts)
        counts = np.diff(np.append(starts, len(sym)))
        over = best == NONE
        if over.any():
            gone = np.repeat(over, counts)
            done.append((sym[gone], word[gone]))
            keep = ~gone
            sym, word, found, rank = sym[keep], word[keep], found[keep], rank[keep]
            best, counts = best[~over], counts[~over]
            if not len(sym):
                break
            starts = np.cumsum(counts) - counts
        low = np.repeat(best, counts)
        take = np.flatnonzero(rank == low)
        if strict:
            w = word[take]
            take = take[np.flatnonzero(np.diff(w, prepend=-1))]
        else:
            run = np.arange(len(take)) - np.maximum.accumulate(np.where(np.diff(take, prepend=-9) != 1, np.arange(len(take)), 0))
            take = take[run % 2 == 0]
        new = pairs.merged[found[take]]
        bad = np.zeros(0, np.int64)
        if not strict:
            beside = np.flatnonzero((np.diff(take) == 2) & (word[take[1:]] == word[take[:-1]]))
            if len(beside):  # between two merges of neighbours the pair (merged, next left) exists for a while
                r = pairs.rank[pairs.find(new[beside], sym[take[beside] + 2])]
                bad = word[take[beside[r < low[take[beside]]]]]
        sym[take] = new
        touched = np.zeros(len(sym), bool)
        touched[take] = True
        touched[take[take > 0] - 1] = True
        keep = np.ones(len(sym), bool)
        keep[take + 1] = False
        many = None
        if not strict:
            several = np.bincount(np.repeat(np.arange(len(counts)), counts)[take], minlength=len(counts)) > 1
            tie = np.isin(best, pairs.tied) if len(pairs.tied) else np.zeros(len(best), bool)
            bad = np.concatenate([bad, word[starts[several & tie]]])
            many = np.repeat(several & ~tie, counts)[keep]
        # the symbol before a dropped one may have to look past it
        prev = take[take > 1]
        touched[prev[~keep[prev - 1]] - 2] = True
        sym, word, found, touched, low = sym[keep], word[keep], found[keep], touched[keep], low[keep]
        i = np.flatnonzero(touched)
        inner = i[i + 1 < len(sym)]
        inner_same = word[inner] == word[np.minimum(inner + 1, len(sym) - 1)]
        found[i] = -1
        look = inner[inner_same]
        found[look] = pairs.find(sym[look], sym[look + 1])
        if not strict:
            outrank = look[many[look] & (pairs.rank[found[look]] < low[look])]
            bad = np.unique(np.concatenate([bad, word[outrank]]))
            if len(bad):
                redo.append(bad)
                stay = ~np.isin(word, bad)
                sym, word, found = sym[stay], word[stay], found[stay]
    return done, np.concatenate(redo) if redo else np.empty(0, np.int64)
