"""Simple-8b: selectors pack varying counts of integers into 64-bit words, vectorised both ways.

The top 4 bits of a word select how many values of how many bits its lower 60 bits hold.  Selector 14
is an escape: the next word is one raw 64-bit value.  Values are cut into blocks; a block starts at a
word, never shares one, and its offset is stored, so blocks decode independently and all at once.
"""

from __future__ import annotations

import numpy as np

#: Values in a word and bits of each, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
ESCAPE = 14
BLOCK = 512
_LIMITS = np.array([(1 << int(w)) - 1 for w in WIDTHS], np.uint64)
#: The first selector whose width fits, of each value of 16 bits.
_NEED = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64)).astype(np.uint8)


def _selectors(values: np.ndarray, block: int) -> np.ndarray:
    """At each place, the selector of the word that would start there: the most values that fit and end in the block."""
    n = len(values)
    need = _NEED[values] if values.max() < len(_NEED) else np.searchsorted(_LIMITS, values).astype(np.uint8)  # ESCAPE where no width fits
    left = np.resize(np.minimum(np.arange(block, 0, -1), 255).astype(np.uint8), n)  # no word holds 255 values
    tail = n % block or block
    left[n - tail :] = np.minimum(np.arange(tail, 0, -1), 255)
    best = np.full(n, ESCAPE, np.uint8)
    top = {1: need}
    for size in (2, 4, 8, 16, 32):  # maxima of runs of so many values
        half = top[size // 2]
        out = half.copy()
        with_next = max(n - size // 2, 0)
        out[:with_next] = np.maximum(half[:with_next], half[size // 2 :][:with_next])
        top[size] = out
    fitting = np.cumsum(np.bincount(need, minlength=ESCAPE + 1))
    for s in range(len(COUNTS) - 1, -1, -1):
        c = int(COUNTS[s])
        if fitting[s] < c:  # too few small values for even one such word
            continue
        p = 1 << (c.bit_length() - 1)
        p = min(p, 32)
        most = top[p]
        if c > p:
            shifted = np.full(n, 255, np.uint8)
            shifted[: max(n - (c - p), 0)] = most[c - p :][: max(n - (c - p), 0)]
            most = np.maximum(most, shifted)
        np.copyto(best, np.uint8(s), where=(most <= s) & (left >= c))
    return best


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, whether each block holds an escape)."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, bool)
    best = _selectors(values, block)
    step = np.append(COUNTS, 1)
    firsts = np.arange(0, n, block)
    ends = np.minimum(firsts + block, n)
    at, starts = firsts.copy(), []
    while len(at):  # all blocks take their next word at once
        starts.append(at)
        at = at + step[best[at]]
        alive = at < ends
        at, ends = at[alive], ends[alive]
    start = np.sort(np.concatenate(starts))
    chosen = best[start]
    place = np.arange(len(start)) + np.concatenate([[0], np.cumsum(chosen == ESCAPE)[:-1]])
    words = np.zeros(len(start) + int((chosen == ESCAPE).sum()), np.uint64)
    for s in np.unique(chosen):
        own = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            words[place[own]] = np.uint64(ESCAPE) << np.uint64(60)
            words[place[own] + 1] = values[start[own]]
            continue
        out = np.full(len(own), np.uint64(int(s)) << np.uint64(60), np.uint64)
        for k in range(int(COUNTS[s])):
            out |= values[start[own] + k] << np.uint64(k * int(WIDTHS[s]))
        words[place[own]] = out
    at = np.searchsorted(start, firsts)
    escaped = np.zeros(len(firsts), bool)
    escaped[start[chosen == ESCAPE] // block] = True
    return words, place[at].astype(np.uint32), escaped


def _decode_run(words: np.ndarray) -> np.ndarray:
    """Values of words without escapes."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[chosen])
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    begins = ends - COUNTS[chosen]
    for s in np.unique(chosen):
        own = np.flatnonzero(chosen == s)
        for k in range(int(COUNTS[s])):
            out[begins[own] + k] = (words[own] >> np.uint64(k * int(WIDTHS[s]))) & _LIMITS[s]
    return out


def _decode_escaped(words: np.ndarray) -> np.ndarray:
    out, i = [], 0
    while i < len(words):
        if int(words[i]) >> 60 == ESCAPE:
            out.append(words[i + 1 : i + 2])
            i += 2
        else:
            out.append(_decode_run(words[i : i + 1]))
            i += 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def decode(words: np.ndarray, firsts: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """All values; runs of blocks without escapes are decoded together."""
    if not len(firsts):
        return np.zeros(0, np.uint64)
    if not escaped.any():
        return _decode_run(words)
    edges = np.append(firsts, len(words)).astype(np.int64)
    return np.concatenate([(_decode_escaped if e else _decode_run)(words[a:b]) for a, b, e in zip(edges, edges[1:], escaped, strict=False)])


def decode_block(words: np.ndarray, firsts: np.ndarray, escaped: np.ndarray, k: int) -> np.ndarray:
    """The values of block k alone."""
    end = int(firsts[k + 1]) if k + 1 < len(firsts) else len(words)
    return (_decode_escaped if escaped[k] else _decode_run)(words[int(firsts[k]) : end])
