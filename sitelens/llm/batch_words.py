"""Token ids of a batch's words, where each distinct part of a word is looked up once.

Splitting, telling words apart and putting their ids in order run on whole batches in
Arrow; only the distinct parts of a batch come to Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sitelens.llm.common import Recent

#: Letters that no normaliser recomposes and every table calls letters.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: ASCII punctuation but the apostrophe, which begins endings, and <, | and >, which spell special tokens.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
_MARK = r"[!-&(-/:;=?@\[-`{}~]"
_ALL_LETTERS = "".join(c for c in map(chr, range(256)) if re.match(f"[{LETTERS}]", c))


def distinct(values: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Number of every value's distinct value, and these."""
    d = values.dictionary_encode()
    return d.indices, d.dictionary


def strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def remembered(memo: Recent, keys: list[str], make: Callable[[list[str]], list[bytes]], longest: int) -> list[bytes]:
    """What ``memo`` has of distinct ``keys``, the rest by one call of ``make``; keys up to ``longest`` are noted."""
    out = memo.get_all(keys)
    late = [i for i, got in enumerate(out) if got is None]
    if late:
        new = [keys[i] for i in late]
        made = make(new)
        for i, ids in zip(late, made, strict=True):
            out[i] = ids
        memo.put_all({k: ids for k, ids in zip(new, made, strict=True) if len(k) <= longest})
    return out


def packed(ids: list[int], sizes: list[int]) -> list[bytes]:
    """Runs of ``ids`` of these sizes, each as packed 32-bit ids, little-endian."""
    raw, at = np.asarray(ids, dtype="<u4").tobytes(), (4 * bounds(np.asarray(sizes, dtype=np.int64))).tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]


Ids = Callable[[list[str]], list[bytes]]


def word_ids(words: pa.Array, core: Ids, marks: Ids, other: Ids, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The words' ids one behind the other, and where each word's begin, with the end.

    A plain word, letters with punctuation behind them, has the ids of its letters
    (``core``, lower-cased on demand) and of its punctuation (``marks``); all others
    come from ``other``.  The functions return packed 32-bit ids, little-endian.
    """
    codes, each = distinct(words)
    plain = pc.match_substring_regex(each, f"^[{LETTERS}]+{_MARK}*$")
    simple = each.filter(plain)
    letters = pc.utf8_rtrim(simple, characters=MARKS)
    core_codes, cores = distinct(pc.utf8_lower(letters) if lower else letters)
    mark_codes, tails = distinct(pc.utf8_ltrim(simple, characters=_ALL_LETTERS))
    of_plain = pc.binary_join_element_wise(
        pa.array(core(strings(cores)), pa.large_binary()).take(core_codes),
        pa.array(marks(strings(tails)), pa.large_binary()).take(mark_codes),
        pa.scalar(b"", pa.large_binary()),
    )
    of_rest = pa.array(other(strings(each.filter(pc.invert(plain)))), pa.large_binary())
    # where a distinct word's ids stand among those of the plain words and, behind them, the rest
    is_plain = plain.to_numpy(zero_copy_only=False).astype(bool)
    place = np.where(is_plain, np.cumsum(is_plain) - 1, len(of_plain) + np.cumsum(~is_plain) - 1)
    ids = pa.concat_arrays([of_plain, of_rest]).take(pa.array(place).take(codes))
    _, starts, raw = ids.buffers()
    at = np.frombuffer(starts, dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(raw or b"", dtype="<u4", count=at[-1] // 4), at // 4


def together(batches: Iterator[pa.Array], most: int) -> Iterator[pa.Array]:
    """Neighbouring batches of texts as one, up to about ``most`` bytes; nulls are empty texts.

    What costs once for each distinct word of a batch is shared by more texts.
    """
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pc.fill_null(pa.concat_arrays(held), "")
            held, size = [], 0
    if held:
        yield pc.fill_null(pa.concat_arrays(held), "")


def bounds(lengths: np.ndarray) -> np.ndarray:
    """Where runs of these lengths begin, and the end."""
    return np.concatenate([[0], np.cumsum(lengths)])
