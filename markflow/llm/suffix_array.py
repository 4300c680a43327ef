"""Suffix arrays by prefix doubling, and permuted common prefixes.

`suffix_array` sorts all suffixes by as many first symbols as fit a 64-bit word beside a place. Suffixes that are still equal
share a rank; they are sorted by it and by the rank of what follows the symbols compared so far, which doubles these, until
no two are equal. A round sorts whole words (key and place together, several times as fast as sorting places by key), and only
the suffixes that are not settled. A string whose longest repeat has r symbols takes some log2(r) rounds.
"""

from __future__ import annotations

import numpy as np


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (below 2^bits) in order, and the places that they come from."""
    own = len(key).bit_length()
    if bits + own > 63:
        order = key.argsort(kind="stable")
        return key[order], order
    key = key << own
    key |= np.arange(len(key))
    key.sort()
    return key >> own, key & ((1 << own) - 1)


def suffix_array(t: np.ndarray, sigma: int = 256) -> np.ndarray:
    """Suffix array of t (symbols below sigma), whose last symbol is 0 and stands nowhere else."""
    n, width = len(t), max(1, (sigma - 1).bit_length())
    bits = n.bit_length()
    h = max(1, (63 - bits) // width)
    room = np.zeros(n + h, np.int64)
    room[:n] = t
    key = room[:n].copy()
    for j in range(1, h):
        key <<= width
        key |= room[j : j + n]
    del room
    kind = np.int32 if n < 1 << 31 else np.int64
    key, sa = _sorted(key, width * h)
    p = sa = sa.astype(kind)
    rank, live = np.empty(n, kind), np.arange(n, dtype=kind)
    while True:  # p: the suffixes at the places `live` of sa, sorted by their first h symbols
        first = np.ones(len(p), bool)
        np.not_equal(key[1:], key[:-1], out=first[1:])
        first = np.flatnonzero(first)
        size = np.diff(first, append=len(p))
        rank[p] = live[first].repeat(size)
        tied = (size > 1).repeat(size)
        live, p = live[tied], p[tied]
        if not len(p):
            return sa
        key = rank[p].astype(np.int64)
        key <<= bits
        key |= rank[p + h]  # equal so far: neither has come to the last symbol
        key, order = _sorted(key, 2 * bits)
        p = p[order]
        sa[live] = p
        h *= 2


def common_prefixes(t: np.ndarray, sa: np.ndarray, texts: np.ndarray, most: int, ends: np.ndarray | None = None) -> np.ndarray:
    """Permuted common prefixes: for each position of t (bytes), how much its suffix shares with the one before it in sa, up to `most`.

    texts: where the texts that make up t start (the first 0); ends: where to stop in each (else where the next one starts;
    0 is returned for what is beyond). Going from one position to the next of a text, at most one symbol of the common prefix
    is lost; all texts take that step together, and compare eight bytes at a time.
    """
    n = len(t)
    room = np.zeros(n + most + 16, np.uint8)
    room[:n] = t
    words = np.ndarray((n + most + 8,), "<u8", room.data, 0, (1,))
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    out = np.zeros(n, np.int32)
    at, run = texts.astype(np.int64), np.zeros(len(texts), np.int64)
    end = np.append(texts[1:], n) if ends is None else ends
    while len(at):
        other = before[at]
        run = np.where(other < 0, 0, np.maximum(run - 1, 0))
        live = np.flatnonzero((other >= 0) & (run < most))
        while len(live):
            so_far = run[live]
            differ = words[at[live] + so_far] ^ words[other[live] + so_far]
            same = np.bitwise_count((differ & -differ) - np.uint64(1)) >> np.uint8(3)  # equal low bytes; 8 if all are
            run[live] = so_far + same
            live = live[(same == 8) & (so_far + 8 < most)]
        run = np.minimum(run, np.minimum(most, n - np.maximum(at, other)))
        out[at] = run
        at = at + 1
        go = at < end
        at, run, end = at[go], run[go], end[go]
    return out
