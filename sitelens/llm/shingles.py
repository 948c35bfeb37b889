"""Word shingles of whole batches of texts, hashed with numpy.

Words are runs of bytes other than blank, tab, LF, VT, FF, CR; a shingle is
``SHINGLE`` words in a row; a text of fewer words is one shingle, an empty text
has none.  Everything runs over the batch's concatenated bytes.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd: has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: all bits depend on all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; ``ends`` closes each text (a word never crosses)."""
    solid = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[0] = True
    cut[ends[ends <= len(data)]] = True
    before = np.concatenate([[False], solid[:-1]]) & ~cut[:-1]
    after = np.concatenate([solid[1:], [False]]) & ~cut[1:]
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word from prefix sums of a polynomial in the bytes."""
    n = len(data)
    power = np.empty(n + 1, dtype=np.uint64)
    power[0] = 1
    power[1:] = _BASE
    np.multiply.accumulate(power, out=power)
    inverse = np.empty(n + 1, dtype=np.uint64)
    inverse[0] = 1
    inverse[1:] = np.uint64(pow(int(_BASE), -1, 1 << 64))
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, shingle hash)`` of every shingle, repeats included, in order."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts, ends = word_spans(data, bounds[1:])
    h = word_hashes(data, starts, ends)
    text = np.searchsorted(bounds, starts, side="right") - 1
    per_text = np.bincount(text, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(per_text)])
    rank = np.arange(len(h)) - first[text]
    # a shingle begins at every word that has size - 1 more behind it, or at the first
    begins = np.flatnonzero((rank + size <= per_text[text]) | (rank == 0))
    out = np.zeros(len(begins), dtype=np.uint64)
    short = per_text[text[begins]] < size
    for j in range(size):
        at = np.minimum(begins + j, len(h) - 1)
        inside = ~short | (rank[begins] + j < per_text[text[begins]])
        out = mix(out + np.where(inside, h[at], np.uint64(j + 1)))
    return text[begins], out


def counted(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(text, hash)`` in order with how often each occurs."""
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.append(at, len(h)))
