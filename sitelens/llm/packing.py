"""Best-two-fit packing of token sequences.

Documents become token pieces of at most ``capacity``; a piece's length is all
that packing looks at, so the packing itself runs on the *histogram* of lengths:
at most ``capacity`` numbers, however many documents there are.

The planner fills one bin greedily with the longest lengths that still fit, then
improves it: the bin's smallest document is taken out, and if two unpacked
documents fit the expanded gap more tightly they take its place (best-two-fit).
The finished bin is a *pattern*; it is repeated as often as the remaining counts
allow, so a step uses up at least one length and the number of steps follows the
number of distinct lengths, not of documents.

Which document goes where: pieces of one length are interchangeable.  Each gets
its ordinal among its length (counts per chunk, prefix sums over the chunks, a
rank inside the chunk); a pattern owns an interval of ordinals of each of its
lengths, and interval arithmetic gives sequence and offset.  The plan has at most
``MAX_DISTINCT`` rows a step; it is looked up with a binary search.

Defined cases: a null text is an empty document (its end token alone); a length
above ``capacity`` is cut into full pieces and a rest; repeated rows are packed
each; an empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.batch_words import bounds, packed, remembered, together, word_ids
from sitelens.llm.common import Recent, held, lean

CACHE_WORDS = 100_000
CACHE_CORES = 400_000
CACHED_CHARS = 64  # longer words are encoded but not remembered
BATCH_BYTES = 4 << 20  # about as much text is encoded together

# ------------------------------------------------------------ tokens


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes
    stand for themselves, the others are numbered on from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCoder:
    """Ids of whole texts by a ``tokenizers`` file, looked up word by word.

    Normaliser and split pattern of a word-end vocabulary work inside runs of
    visible characters, so a text may be cut at ASCII white space.  Of plain words
    with punctuation the two parts, which the split pattern separates, go to the
    library's model directly; every other distinct word is encoded by the library.
    A batch looks up each distinct part once, and the ids are remembered packed.
    Special tokens spelt out in a text get their own ids, as in the library's plain
    call; they hold no white space.  Two generations of ``CACHE_WORDS`` words and
    ``CACHE_CORES`` parts are kept: some 200 MB at most in a worker.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        self.letters = "".join(v for _, v in sorted(_byte_letters().items()))
        self.words = Recent(CACHE_WORDS)
        self.cores = Recent(CACHE_CORES)

    def _cores(self, parts: list[str]) -> list[bytes]:
        """Ids of parts of plain words: lower-cased letters, or punctuation."""
        tokenize, letters = self.model.tokenize, self.letters
        ids, sizes = [], []
        for part in parts:
            if not part.isascii():
                part = part.encode().decode("latin-1").translate(letters)
            found = tokenize(part) if part else ()
            ids += [t.id for t in found]
            sizes.append(len(found))
        return packed(ids, sizes)

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of any words."""
        found = [self.lib.encode(w, add_special_tokens=False).ids if w else () for w in words]
        return packed([i for ids in found for i in ids], list(map(len, found)))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids one behind the other, and where each text's begin, with the end."""
        split = pc.ascii_split_whitespace(texts)
        parts = partial(remembered, self.cores, make=self._cores, longest=CACHED_CHARS)
        words = partial(remembered, self.words, make=self._words, longest=CACHED_CHARS)
        ids, at = word_ids(split.flatten(), parts, parts, words, lower=True)
        return ids, at[bounds(split.value_lengths().to_numpy())]

    def pack_all(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of every text."""
        ids, at = self.encode_all(pa.array([t or "" for t in texts], pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]

    def pack(self, text: str | None) -> bytes:
        """The packed ids of a text."""
        return self.pack_all([(text or "").encode("utf-8", "replace").decode()])[0]


_CODERS: dict[str, WordCoder] = held("packing")


def word_coder(path: str) -> WordCoder:
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


PIECE = "struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>"


def cut_pieces(ids: np.ndarray, at: np.ndarray, capacity: int, end_id: int) -> pa.ListArray:
    """The pieces of texts whose ids stand at ``at`` in ``ids``, each with ``end_id`` behind."""
    length = np.diff(at) + 1
    n = -(-length // capacity)
    first = bounds(n)
    text = np.repeat(np.arange(len(n)), n)
    piece = np.arange(first[-1]) - first[text]
    start = piece * capacity
    size = np.minimum(length[text] - start, capacity)
    end, raw = np.asarray([end_id], dtype="<u4").tobytes(), memoryview(ids).cast("B")
    begin = 4 * (at[:-1][text] + start)
    stop = np.minimum(begin + 4 * size, 4 * at[1:][text])  # the last piece ends with the end token, which is not in ids
    crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), stop.tolist())]
    for last in (first[1:] - 1).tolist():
        crc[last] = zlib.crc32(end, crc[last])
    columns = [pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays(columns, ["piece", "start", "length", "ids_crc32"]))


def pieces(text: Column, path: str, capacity: int, end_id: int) -> Column:
    """Array of a document's pieces: number, start, length and CRC-32 of its ids."""

    @F.arrow_udf(T.ArrayType(T._parse_datatype_string(PIECE)))
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean("packing")
        coder = word_coder(path)
        for texts in together(batches, BATCH_BYTES):
            yield cut_pieces(*coder.encode_all(texts), capacity, end_id)

    return cut(text)


# ------------------------------------------------------------ the plan


class _Lengths:
    """Remaining counts by length, with 'largest length at most x' queries."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: v for k, v in counts.items() if v > 0}
        self.keys = sorted(self.count)

    def at_most(self, x: int, used: dict[int, int]) -> int:
        """The largest length <= x of which an unused document is left, or 0."""
        i = bisect_right(self.keys, x)
        while i:
            k = self.keys[i - 1]
            if self.count[k] > used.get(k, 0):
                return k
            i -= 1
        return 0

    def take(self, used: dict[int, int], times: int) -> None:
        for k, n in used.items():
            self.count[k] -= n * times
            if not self.count[k]:
                del self.count[k]
                self.keys.remove(k)


def _best_two(lengths: _Lengths, gap: int, used: dict[int, int], floor: int) -> tuple[int, int]:
    """Two unpacked lengths with the largest sum in (floor, gap], or (0, 0)."""
    best, pair = floor, (0, 0)
    keys = lengths.keys
    for i in range(bisect_right(keys, gap) - 1, -1, -1):
        a = keys[i]
        if 2 * a <= best:
            break  # the longer of the two is too short to do better
        if lengths.count[a] <= used.get(a, 0):
            continue
        held = dict(used)
        held[a] = held.get(a, 0) + 1
        b = lengths.at_most(min(gap - a, a), held)
        if b and a + b > best:
            best, pair = a + b, (a, b)
            if best == gap:
                break
    return pair


def one_bin(lengths: _Lengths, capacity: int) -> dict[int, int]:
    """Length -> how many of it, for the next bin."""
    used: dict[int, int] = {}
    gap = capacity
    while gap and (k := lengths.at_most(gap, used)):
        used[k] = used.get(k, 0) + 1
        gap -= k
    if gap and len(used) + max(used.values()) > 2:  # more than one document: the smallest may make way
        smallest = min(used)
        without = dict(used)
        without[smallest] -= 1
        if not without[smallest]:
            del without[smallest]
        a, b = _best_two(lengths, gap + smallest, without, smallest)
        if a:
            for k in (a, b):
                without[k] = without.get(k, 0) + 1
            used = without
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, first ordinal, repeats, first sequence, offset)``.

    The row's ordinals are ``first + c * repeats + r`` for copy ``c`` and bin
    ``r``: sequence ``first sequence + r``, offset ``offset + c * length``.
    """
    lengths, rows, sequence, ordinal = _Lengths(counts), [], 0, {}
    while lengths.keys:
        used = one_bin(lengths, capacity)
        times = min(lengths.count[k] // n for k, n in used.items())
        at = 0
        for k in sorted(used, reverse=True):
            first = ordinal.get(k, 0)
            rows.append((k, first, times, sequence, at))
            ordinal[k] = first + used[k] * times
            at += k * used[k]
        lengths.take(used, times)
        sequence += times
    return rows


def _assign(rows: list[tuple[int, int, int, int, int]]):
    table = np.asarray(sorted(rows), dtype=np.int64).reshape(-1, 5)

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def locate(length: pd.Series, ordinal: pd.Series) -> pd.DataFrame:
        n, o = length.to_numpy(np.int64), ordinal.to_numpy(np.int64)
        # rows are sorted by (length, first ordinal); one key orders both
        width = np.int64(1) << 45
        i = np.searchsorted(table[:, 0] * width + table[:, 1], n * width + o, side="right") - 1
        _, first, times, sequence, at = table[i].T
        copy, r = np.divmod(o - first, times)
        return pd.DataFrame({"sequence_id": sequence + r, "offset": at + copy * n})

    return locate


# ------------------------------------------------------------ on Spark


def pack(rows: DataFrame, capacity: int, chunk: Column) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` column.

    ``rows`` must be stored (read twice); ``chunk`` spreads them for ranking and
    has to be a function of a row's own values.  The histogram, at most
    ``capacity`` rows, is all the driver sees.
    """
    from pyspark.sql import Window

    spread = rows.withColumn("__chunk", chunk)
    per_chunk = spread.groupBy("length", "__chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_chunk.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = plan(counts, capacity)
    if not steps:
        return rows.withColumns({"sequence_id": F.lit(None).cast("bigint"), "offset": F.lit(None).cast("bigint")})
    # the order inside a chunk does not matter, but has to be the same on a retry
    inside = Window.partitionBy("__chunk", "length").orderBy(*[c for c in rows.columns])
    ranked = spread.withColumn("__rank", F.row_number().over(inside) - 1).join(starts, ["length", "__chunk"])
    placed = ranked.withColumn("__at", _assign(steps)(F.col("length"), F.col("before") + F.col("__rank")))
    return placed.select(*rows.columns, F.col("__at.sequence_id").alias("sequence_id"), F.col("__at.offset").alias("offset"))
