"""Cuts texts into pre-tokens with whole-array byte operations.

Stretches of ASCII and Latin letters, digits, marks and ASCII white space are cut here;
a stretch between white space that holds anything else (an apostrophe, other scripts,
control characters) stays whole and is left to the tokenizer library.
"""

from __future__ import annotations

import numpy as np

SPACE, WHITE, LETTER, DIGIT, MARK, OTHER = range(6)
_TABLE = np.full(256, OTHER, np.uint8)
_TABLE[33:127] = MARK
_TABLE[48:58] = DIGIT
_TABLE[65:91] = _TABLE[97:123] = LETTER
_TABLE[[9, 10, 11, 12, 13]] = WHITE
_TABLE[32] = SPACE
_TABLE[39] = OTHER


def classes(buf: np.ndarray, extended: bool) -> np.ndarray:
    """A class per byte; extended also takes U+0100 to U+017F as letters beside U+00C0 to U+00FF."""
    cls = _TABLE[buf]
    lead = np.flatnonzero((buf[:-1] == 0xC3) | (extended & ((buf[:-1] == 0xC4) | (buf[:-1] == 0xC5))))
    after = buf[lead + 1]
    lead = lead[~((buf[lead] == 0xC3) & ((after == 0x97) | (after == 0xB7)))]  # the signs for times and divided
    cls[lead] = LETTER
    cls[lead + 1] = LETTER
    return cls


def cut(buf: np.ndarray, at: np.ndarray, *, spaces_join: bool, extended: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, whether whole (for the library), and class of the segments of texts at[i]:at[i + 1].

    spaces_join: white space belongs to the segments as in byte-level pre-tokenisation (the last
    space of a run leads the next word); else it is dropped and each digit stands alone."""
    n = len(buf)
    empty = np.empty(0, np.int64)
    if not n:
        return empty, empty, empty.astype(bool), empty
    cls = classes(buf, extended)
    ws = cls <= WHITE
    begin = np.zeros(n, bool)
    begin[at[:-1][np.diff(at) > 0]] = True
    prev_ws = np.append(False, ws[:-1])
    ws_start = ws & (~prev_ws | begin)
    chunk_start = ws_start | begin
    first = np.flatnonzero(chunk_start)
    whole = np.add.reduceat((cls == OTHER).astype(np.int32), first) > 0
    cutting = chunk_start.copy()
    if spaces_join:
        last_ws = np.zeros(n, bool)
        last_ws[:-1] = ws[:-1] & ~ws[1:] & ~begin[1:]
        cutting |= last_ws & ~ws_start
        cutting[1:] |= last_ws[:-1] & (cls[:-1] == WHITE)
        cutting[1:] |= ~ws[1:] & ~ws[:-1] & (cls[1:] != cls[:-1])
    else:
        cutting[1:] |= ~ws[1:] & ((cls[1:] != cls[:-1]) | (cls[1:] == DIGIT))
        cutting[1:] |= ws[1:] & ~ws[:-1]
    in_whole = np.repeat(whole, np.diff(np.append(first, n)))
    if spaces_join:
        cutting &= ~in_whole | chunk_start
    else:
        cutting &= ~in_whole | chunk_start | (prev_ws & ~ws)
    s = np.flatnonzero(cutting)
    e = np.append(s[1:], n)
    if not spaces_join:
        keep = ~ws[s]
        s, e = s[keep], e[keep]
    return s, e, in_whole[s], cls[s]
