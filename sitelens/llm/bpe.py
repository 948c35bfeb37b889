"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton.

The vocabulary is a rank file: every line a base64 token and its rank.  A piece
of text (one match of the split pattern) is mapped byte by byte to Latin-1, so
the automaton of ``pyahocorasick``, which works on characters, works on bytes.

Encoding of one piece:

* one pass of the automaton gives the longest token that starts at every byte;
* walking left to right, the longest token at the position is tried first, then
  its ever shorter prefixes.  It is taken if merging would keep it next to the
  token before it (*compatible* pair) and its end is not a known dead end; if
  none fits, the previous token is given back and the position marked dead.

A pair is compatible if undoing the merges of both sides, youngest first, never
uncovers a pair that would have merged earlier; the answer is memoised.  This
yields exactly the sequence the merges would, and every byte position is left at
most once per token that ends there, so time is linear in the piece's length.

Where a batch brings many new short pieces, their merges are carried out in step
on a matrix (``Merges``) instead, with the same ids.

The tables are built once per Python worker from the file; the memos of
pieces and words keep two generations of ``CACHE_PIECES`` and ``CACHE_WORDS``
entries, so memory stays bounded.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.batch_words import bounds, remembered, strings, together, word_ids
from sitelens.llm.common import Recent, held, lean

CACHE_PIECES = 200_000
CACHE_WORDS = 100_000
CACHE_PAIRS = 1_000_000
CACHED_BYTES = 256  # longer pieces are encoded but not remembered
BATCH_BYTES = 2 << 20  # about as much text is encoded together
MATRIX_BYTES = 32  # pieces up to this long are merged in step,
MATRIX_PIECES = 200  # if there are so many that it is quicker than one by one


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A blank at an end of a text or next to other white space.
ODD_BLANK = rf"\A | \z|{_SPACE} | {_SPACE}"


class Merges:
    """All merges of a rank file, carried out on many pieces in step.

    Pieces stand in a matrix of tokens, one a row.  A step merges in every row the
    leftmost pair of lowest rank, so rows lose one column each; rows without a pair
    are done, and shorter pieces come in when the matrix is as narrow as they are.
    """

    NONE = np.iinfo(np.int32).max

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = np.asarray([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        self.top = max(ranks.values()) + 1
        found = {}
        for t, r in ranks.items():
            for n in range(1, len(t)):
                a = ranks.get(t[:n])
                b = ranks.get(t[n:]) if a is not None else None
                if b is not None:
                    found[a * self.top + b] = r
        self.keys = np.asarray(sorted(found), dtype=np.int64)
        self.made = np.asarray([found[k] for k in self.keys.tolist()], dtype=np.int32)
        left, right = np.divmod(np.arange(1 << 16), 256)
        self.first = self._ranks(self.byte[left], self.byte[right])

    @property
    def complete(self) -> bool:
        """Whether every byte is a token and some merge exists."""
        return len(self.keys) > 0 and bool((self.byte >= 0).all())

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What the pairs merge to, or ``NONE``."""
        if not len(self.keys):
            return np.full(len(a), self.NONE, dtype=np.int32)
        key = a.astype(np.int64) * self.top + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], self.NONE)

    def packed(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of every piece, none of them empty."""
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_size.setdefault(len(p), []).append(i)
        out: list[bytes] = [b""] * len(pieces)
        width = max(by_size, default=0)
        token = np.empty((0, width), dtype=np.int32)
        rank = np.empty((0, max(0, width - 1)), dtype=np.int32)
        which = np.empty(0, dtype=np.int64)
        for width in range(width, 0, -1):
            if width in by_size:
                new = by_size.pop(width)
                raw = np.frombuffer(b"".join([pieces[i] for i in new]), dtype=np.uint8).reshape(-1, width)
                token = np.concatenate([token, self.byte[raw]])
                rank = np.concatenate([rank, self.first[raw[:, :-1].astype(np.int64) * 256 + raw[:, 1:]]])
                which = np.concatenate([which, np.asarray(new)])
            if not len(which):
                token, rank = token[:, 1:], rank[:, 1:]
                continue
            if width > 1:
                at = rank.argmin(axis=1)
                low = rank[np.arange(len(at)), at]
                done = low == self.NONE
            else:
                done = np.ones(len(which), dtype=bool)
            raw, step = token[done].astype("<u4").tobytes(), 4 * width
            for k, i in enumerate(which[done].tolist()):
                out[i] = raw[k * step : (k + 1) * step]
            if width == 1:
                break
            on = ~done
            token, rank, which, at, low = token[on], rank[on], which[on], at[on], low[on]
            row = np.arange(len(which))
            token[row, at] = low  # a token's id is its rank
            stay = np.ones(token.shape, dtype=bool)
            stay[row, at + 1] = False
            token = token[stay].reshape(len(which), width - 1)
            stay = np.ones(rank.shape, dtype=bool)
            stay[row, at] = False
            rank = rank[stay].reshape(len(which), width - 2)
            r = np.flatnonzero(at > 0)
            rank[r, at[r] - 1] = self._ranks(token[r, at[r] - 1], token[r, at[r]])
            r = np.flatnonzero(at < width - 2)
            rank[r, at[r]] = self._ranks(token[r, at[r]], token[r, at[r] + 1])
        return out


class Tokens:
    """The bytes of every id, in Arrow."""

    def __init__(self, ranks: dict[bytes, int]):
        token = {r: t for t, r in ranks.items()}
        self.bytes = pa.array([token.get(r) for r in range(max(token) + 1)], pa.large_binary())

    def join(self, ids: pa.Array, at: np.ndarray) -> pa.BinaryArray:
        """The bytes of the runs of ``ids`` between the places ``at``."""
        found = self.bytes.take(ids)
        if found.null_count:
            raise ValueError("an id that is no token")
        _, starts, raw = found.buffers()
        starts = np.frombuffer(starts, dtype=np.int64)[: len(found) + 1] if len(found) else np.zeros(1, dtype=np.int64)
        ends = pa.py_buffer(starts[at].astype(np.int32))
        return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, ends, raw or pa.py_buffer(b"")])


class BytePairCoder:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.pieces = Recent(CACHE_PIECES)
        self.words = Recent(CACHE_WORDS)
        self._compat: dict[tuple[int, int], bool] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        reachable = self._derive_merges()
        top = max(self.token) + 1
        self.tokens = Tokens(ranks)
        self.merges = Merges(ranks)
        self.sizes = [len(self.token.get(r, b"")) for r in range(top)]
        self.shorter = [self._longest_proper_prefix(self.token[r], reachable) if r in reachable else -1 for r in range(top)]
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_STRING)
        for r in reachable:
            t = self.token[r]
            self.trie.add_word(t.decode("latin-1"), r)
        self.trie.make_automaton()

    def _longest_proper_prefix(self, t: bytes, among: set[int]) -> int:
        for n in range(len(t) - 1, 0, -1):
            r = self.ranks.get(t[:n])
            if r is not None and r in among:
                return r
        return -1

    def _derive_merges(self) -> set[int]:
        """The last merge of every token; a token no merge builds is left out.

        By rising rank: the two halves are older tokens that stay apart until
        this token's own rank, so they must be a compatible pair.
        """
        reachable = set()
        for r in sorted(self.token):
            t = self.token[r]
            if len(t) == 1:
                self.parts[r] = (r, r)
                reachable.add(r)
                continue
            for n in range(len(t) - 1, 0, -1):
                a, b = self.ranks.get(t[:n]), self.ranks.get(t[n:])
                if a is None or b is None or a >= r or b >= r or a not in reachable or b not in reachable:
                    continue
                if self._undo(a, b):
                    self.parts[r] = (a, b)
                    self.merged[a, b] = r
                    reachable.add(r)
                    break
        self._compat.clear()
        return reachable

    def _undo(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` stay side by side under the merges."""
        limit = 1 << 62
        while True:
            made = self.merged.get((a, b))
            if made is not None and made < limit:
                return False
            if a > b:  # the right part of the younger token is what touches the border
                limit, right = a, self.parts[a][1]
                if right == a:
                    limit, left = b + 1, self.parts[b][0]
                    if left == b:
                        return True
                    b = left
                else:
                    a = right
            else:
                limit, left = b + 1, self.parts[b][0]
                if left == b:
                    limit, right = a, self.parts[a][1]
                    if right == a:
                        return True
                    a = right
                else:
                    b = left

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one match of the split pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        latin, sizes, compat = piece.decode("latin-1"), self.sizes, self._compat
        greedy = [r for _, r in self.trie.iter_long(latin)]
        for pair in zip(greedy, greedy[1:]):
            apart = compat.get(pair)
            if apart is None:
                if len(compat) >= CACHE_PAIRS:
                    compat.clear()
                apart = compat[pair] = self._undo(*pair)
            if not apart:
                break
        else:
            return tuple(greedy)  # longest matches that all stay apart need no way back
        n = len(piece)
        longest = [0] * n
        for end, r in self.trie.iter(latin):  # of one start, longer tokens end later
            longest[end - sizes[r] + 1] = r
        alive = [True] * (n + 1)
        shorter = self.shorter
        out: list[int] = []
        at, cand, last = 0, longest[0], -1
        while at < n:
            while True:
                end = at + sizes[cand]
                if alive[end]:
                    ok = True
                    if last >= 0:
                        key = (last, cand)
                        if key in compat:
                            ok = compat[key]
                        else:
                            if len(compat) >= CACHE_PAIRS:
                                compat.clear()
                            ok = compat[key] = self._undo(last, cand)
                    if ok:
                        out.append(cand)
                        last, at = cand, end
                        if at < n:
                            cand = longest[at]
                        break
                cand = shorter[cand]
                if cand < 0:  # nothing fits here: give the last token back
                    alive[at] = False
                    cand = out.pop()
                    at -= sizes[cand]
                    last = out[-1] if out else -1
                    break
        return tuple(out)

    def _encode_new(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of distinct matches of the split pattern."""
        raws = [p.encode("utf-8", "replace") for p in pieces]
        out = [b""] * len(raws)
        short = [i for i, raw in enumerate(raws) if 0 < len(raw) <= MATRIX_BYTES and raw not in self.ranks]
        if len(short) < MATRIX_PIECES or not self.merges.complete:
            short = []
        for i, ids in zip(short, self.merges.packed([raws[i] for i in short]), strict=True):
            out[i] = ids
        for i, raw in enumerate(raws):
            if raw and not out[i]:
                ids = self.encode_piece(raw)
                out[i] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _each(self, pieces: list[str]) -> list[bytes]:
        return remembered(self.pieces, pieces, self._encode_new, CACHED_BYTES)

    def _texts(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts by the split pattern."""
        found = list(map(self.find, texts))
        each = list(dict.fromkeys(chain.from_iterable(found)))
        ids = dict(zip(each, self._each(each), strict=True))
        return [b"".join([ids[p] for p in f]) for f in found]

    def _blank_words(self, words: list[str]) -> list[bytes]:
        return remembered(self.words, words, lambda new: self._texts([" " + w for w in new]), CACHED_BYTES)

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts one behind the other, and where each text's begin, with the end.

        A single blank between two visible characters always starts a match, so
        a text may be cut in front of each.  Texts whose blanks all stand so are
        looked up word by word, where letters and the punctuation behind them are
        two matches; others go through the split pattern as a whole.
        """
        odd = pc.match_substring_regex(texts, ODD_BLANK)
        split = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        starts = bounds(split.value_lengths().to_numpy())
        words = split.flatten()
        follows = np.ones(len(words), dtype=bool)
        follows[starts[:-1]] = False  # a text's first word has no blank
        ids, at = word_ids(
            words.filter(pa.array(follows)), lambda cores: self._each([" " + c for c in cores]), self._each, self._blank_words
        )
        ends = at[starts - np.arange(len(starts))]
        firsts = self._texts(strings(words.filter(pa.array(~follows))))
        regular = ((w, ids[a:b]) for w, a, b in zip(firsts, ends, ends[1:]))
        others = ((self._texts([t])[0],) for t in strings(texts.filter(odd)))
        parts, sizes = [], []
        for o in odd.to_numpy(zero_copy_only=False).tolist():
            one = [np.frombuffer(p, dtype="<u4") for p in next(others if o else regular)]
            parts += one
            sizes.append(sum(map(len, one)))
        return np.concatenate([*parts, np.empty(0, dtype="<u4")]).astype("<u4", copy=False), bounds(sizes)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        ids, at = self.encode_batch(pa.array(texts, pa.string()))
        return [ids[a:b].view("<i4") for a, b in zip(at, at[1:])]

    def encode(self, text: str) -> list[int]:
        """Ids of one whole text."""
        return self.encode_all([text.encode("utf-8", "replace").decode()])[0].tolist()

    def decode(self, ids) -> bytes:
        ids = np.asarray(ids, dtype=np.int64)
        return self.tokens.join(pa.array(ids), np.asarray([0, len(ids)]))[0].as_py()


_CODERS: dict[tuple[str, str], BytePairCoder] = held("bpe")


def coder(path: str, pattern: str) -> BytePairCoder:
    """The coder of a rank file, built once per Python process."""
    key = (path, pattern)
    if key not in _CODERS:
        _CODERS[key] = BytePairCoder(read_ranks(path), pattern)
    return _CODERS[key]


_TOKENS: dict[str, Tokens] = held("bpe tokens")


def tokens(path: str) -> Tokens:
    """The tokens of a rank file, read once per Python process."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(read_ranks(path))
    return _TOKENS[path]


def encode(text: Column, path: str, pattern: str) -> Column:
    """Token ids of ``text`` (null: no ids).

    An iterator function: Spark runs it once a row, also where ``decode`` reads
    the same ids, and neighbouring batches are encoded together."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def bpe_encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean("bpe")
        c = coder(path, pattern)
        for texts in together(batches, BATCH_BYTES):
            ids, at = c.encode_batch(texts)
            yield pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view("<i4")))

    return bpe_encode(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that ``ids`` stand for (null: empty)."""

    @F.arrow_udf(T.BinaryType())
    def bpe_decode(x: pa.Array) -> pa.Array:
        return tokens(path).join(x.flatten(), bounds(pc.fill_null(pc.list_value_length(x), 0).to_numpy()))

    return bpe_decode(ids)
