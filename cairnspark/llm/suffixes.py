"""Suffix arrays of streams of numbers and what follows from them, by whole-array operations in linear memory."""

from __future__ import annotations

import numpy as np

#: Cells compared at once.
_CELLS = 1 << 18


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Places of s in the order of their suffixes. The last number of s must be one that comes once."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    rank = np.empty(n, np.int64)
    live, key, h = np.arange(n), s[order], 0
    while len(live):
        if h:
            i = order[live]
            key = rank[i] * n + rank[i + h]
            turn = np.argsort(key)
            order[live], key = i[turn], key[turn]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(new, len(live)))
        rank[order[live]] = np.repeat(live[new], size)
        live = live[np.repeat(size > 1, size)]
        h = h * 2 or 1
    return order


def agreeing(s: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many numbers are alike from a and from b on, forwards (1) or backwards (-1). Both ends of s have numbers that come once."""
    out = np.zeros(len(a), np.int64)
    for lo in range(0, len(a), _CELLS):
        live, width = np.arange(lo, min(lo + _CELLS, len(a))), 1
        while len(live):
            at = out[live, None] + np.arange(width)
            ends = np.clip(a[live, None] + step * at, 0, len(s) - 1), np.clip(b[live, None] + step * at, 0, len(s) - 1)
            differ = s[ends[0]] != s[ends[1]]
            found = differ.any(1)
            out[live] += np.where(found, differ.argmax(1), width)
            live = live[~found]
            width = min(width * 4, max(1, _CELLS // max(1, len(live))))
    return out


def common_prefixes(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each suffix in the order, the numbers that it shares with the one before; -1 for the first and one past the end.

    A suffix whose pair is its left neighbour's pair moved by one shares one number less than that; only the others are compared."""
    n = len(s)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    own = np.arange(n)
    known = (own > 0) & (before > 0)
    known[known] = s[own[known] - 1] == s[before[known] - 1]
    ask = np.flatnonzero(~known & (before >= 0))
    shared = np.full(n, -1)
    shared[ask] = agreeing(s, ask, before[ask], 1)
    since = np.maximum.accumulate(np.where(known, 0, own))
    shared = np.where(known, shared[since] + since - own, shared)
    return np.append(shared[order], -1)


def smaller_before(v: np.ndarray) -> np.ndarray:
    """The last place before each with a smaller value, 0 if there is none."""
    at = np.maximum(np.arange(len(v)) - 1, 0)
    live = np.arange(1, len(v))
    while len(live):
        c = at[live]
        more = (v[c] >= v[live]) & (c > 0)
        live, c = live[more], c[more]
        at[live] = at[c]
    return at
