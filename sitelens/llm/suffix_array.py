"""Suffix order of a text by the difference-cover algorithm, with numpy.

Positions ``i mod 3 != 0`` are the sample.  Their triples are sorted and named;
if names repeat, the algorithm recurses on the string of names.  The remaining
suffixes are sorted by (symbol, rank of the next suffix), which the sample gives,
and merged in.

``depth`` is the prefix length that matters: the result is a permutation in which
suffixes that agree on their first ``depth`` symbols are adjacent, and the blocks
of such suffixes are in lexicographic order.  So the recursion ends when names
cover ``depth`` symbols; with ``depth >= len(s)`` it is the full suffix array.
"""

from __future__ import annotations

import numpy as np

_BITS = 21  # three symbols fit one 64-bit key
_PAIR = np.uint64(1 << _BITS)


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sort order of triples, names from 1 in that order, number of names."""
    if max(int(a.max(initial=0)), int(b.max(initial=0)), int(c.max(initial=0))) < (1 << _BITS):
        key = (a.astype(np.uint64) * _PAIR + b.astype(np.uint64)) * _PAIR + c.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        new = key[order][1:] != key[order][:-1]
    else:
        order = np.lexsort((c, b, a))
        new = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0) | (np.diff(c[order]) != 0)
    rank = np.concatenate([[1], 1 + np.cumsum(new)])
    names = np.empty(len(order), dtype=np.int64)
    names[order] = rank
    return order, names, int(rank[-1])


def _count_below(sorted_cols: tuple[np.ndarray, ...], cols: tuple[np.ndarray, ...]) -> np.ndarray:
    """How many of the sorted tuples are smaller than each of ``cols``."""
    widths = [int(max(s.max(initial=0), c.max(initial=0))).bit_length() for s, c in zip(sorted_cols, cols, strict=True)]
    if sum(widths) < 64:

        def packed(parts: tuple[np.ndarray, ...]) -> np.ndarray:
            key = np.zeros(len(parts[0]), dtype=np.uint64)
            for part, width in zip(parts, widths, strict=True):
                key = (key << np.uint64(width)) | part.astype(np.uint64)
            return key

        return np.searchsorted(packed(sorted_cols), packed(cols), side="left")
    m, n = len(sorted_cols[0]), len(cols[0])
    both = [np.concatenate([s, c]) for s, c in zip(sorted_cols, cols, strict=True)]
    is_query = np.concatenate([np.ones(m, np.int8), np.zeros(n, np.int8)])  # queries first among equals
    order = np.lexsort((is_query, *both[::-1]))
    below = np.cumsum(order < m)
    out = np.empty(m + n, dtype=np.int64)
    out[order] = below
    return out[m:]


def _sorted_pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Order of (first, second) pairs of whole numbers below 2**31."""
    return np.argsort((first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64), kind="stable")


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``s`` (integers >= 1) in suffix order, as deep as ``depth``."""
    n = len(s)
    if n < 3 or depth <= 1:
        if n < 3 and depth > 1:
            return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
        return np.argsort(s, kind="stable")
    t = np.concatenate([s.astype(np.int64), np.zeros(3, dtype=np.int64)])
    # one sample more when n mod 3 is 1, so that the last remaining suffix has a ranked successor
    ones = np.arange(1, n + (n % 3 == 1), 3)
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    order, names, count = _names(t[sample], t[sample + 1], t[sample + 2])
    if count < len(sample) and depth > 3:
        order = suffix_order(names, -(-depth // 3))
    ranked = sample[order]
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[ranked] = np.arange(1, len(ranked) + 1)

    rest = np.arange(0, n, 3)
    rest = rest[_sorted_pairs(t[rest], rank[rest + 1])]
    is_one = ranked % 3 == 1
    one, two = ranked[is_one], ranked[~is_one]
    before = _count_below((t[one], rank[one + 1]), (t[rest], rank[rest + 1]))
    before += _count_below((t[two], t[two + 1], rank[two + 2]), (t[rest], t[rest + 1], rank[rest + 2]))
    # among suffixes that agree to the depth, counts may not rise; their order is free
    before = np.maximum.accumulate(before)
    merged = np.empty(len(rest) + len(ranked), dtype=np.int64)
    slot = before + np.arange(len(rest))
    merged[slot] = rest
    free = np.ones(len(merged), dtype=bool)
    free[slot] = False
    merged[free] = ranked
    return merged[merged < n]
