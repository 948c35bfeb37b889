"""Removal of repeated passages by distributed difference-cover suffix sorting.

A *window* is a string of ``WINDOW`` (100) bytes inside one text.  A window is a
repeat if an equal one starts earlier (smaller doc_id, or same row, earlier
start); all bytes that repeats cover are removed, as judged on the input.

How the suffix sort is distributed:

1. *Anchors.*  The anchor of a window is the smallest hashed ``GRAM``-byte string
   in it (leftmost among equals).  It depends on the window's bytes alone, so
   equal windows have equal anchors at the same distance.  Consecutive windows
   with one anchor form a *run*: a start, a number of windows, and their bytes.
2. *Chunks.*  Every task packs its rows into compressed chunks of bounded size and
   emits the chunk's distinct anchors.  Anchors that occur once in the corpus
   cannot belong to a repeated window; which occur again is decided bucket by
   bucket, and each chunk gets its own list back.
3. *Runs.*  A chunk emits its runs with repeated anchors.  Of equal runs in a chunk
   the first is emitted, the others are repeats already.
4. *Suffix arrays.*  Runs meet by anchor in buckets of bounded size.  In a bucket
   the difference-cover algorithm (sort sampled triples, recurse on their names,
   merge the remaining suffixes) orders the suffixes to the depth of a window;
   suffixes that are windows are compared with the one before on all their bytes;
   in every block of equal windows all but the earliest are repeats.  Because equal
   windows share their anchor, no repeat is split between buckets.
5. *Hot anchors.*  An anchor with more than ``HOT_RUNS`` runs (a passage that a
   third of all texts quote, each in its own surroundings) is not one group: its
   windows are dealt to buckets one by one, by a hash of all their bytes.  Of equal
   windows in a chunk the first is emitted, the others are repeats already, so a
   bucket gets a window's text at most once from each chunk.
6. *Cutting.*  Repeats return to their chunk as byte spans; touching or overlapping
   spans are merged per row and cut out.

Hashes only decide what is looked at and where; every repeat is confirmed byte by
byte, except that equal runs and equal hot windows *within one chunk* are told by
128 hash bits.

Defined cases: null text is empty; texts shorter than a window never change; rows
are ordered by doc_id (null first), rows with one doc_id by their place in the
input; an empty table gives no rows; all columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.common import lean, materialize
from sitelens.llm.shingles import mix
from sitelens.llm.suffix_array import suffix_order

WINDOW = 100
GRAM = 32
CHUNK_BYTES = 4 << 20
BUCKET_ANCHORS = 1_000_000
BUCKET_BYTES = 4 << 20  # of text, for which a bucket is made
HOT_RUNS = 10_000
_BLOCK = 1 << 25  # bytes whose windows are anchored at a time
_AT_BITS = np.uint64(26)
_BASE = 0x9E3779B97F4A7C15
_BASE_2 = 0xD1342543DE82EF95

# ------------------------------------------------------------ anchors of a text


class Rolling:
    """Hashes of any substrings of a byte array, from prefix sums."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        n = len(data)
        power = np.full(n + 1, base, dtype=np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.inverse = np.full(n + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
        self.inverse[0] = 1
        np.multiply.accumulate(self.inverse, out=self.inverse)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        letters = mix(np.arange(1, 257, dtype=np.uint64))
        np.cumsum(letters[data] * power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def every(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def runs_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first window, number of windows, anchor hash)`` of every run.

    ``data`` holds texts one after the other, ``bounds`` their ends and starts.
    """
    parts = []
    for a in range(0, max(len(data) - WINDOW + 1, 0), _BLOCK):
        piece = data[a : a + _BLOCK + WINDOW - 1]
        starts, sizes, h = _runs_in(piece, np.clip(bounds - a, 0, len(piece)))
        parts.append((starts + a, sizes, h))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _runs_in(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grams = Rolling(data).every(GRAM)
    n, width = len(data) - WINDOW + 1, WINDOW - GRAM + 1
    low = (grams >> _AT_BITS << _AT_BITS) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= width:  # minimum over spans that double, then two that overlap
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[width - span : width - span + n])
    at = (low & ((np.uint64(1) << _AT_BITS) - np.uint64(1))).astype(np.int64)
    # windows must not cross from one text into the next
    ok = np.ones(n, dtype=bool)
    for b in np.unique(bounds):
        if 0 < b < len(data):
            ok[max(b - WINDOW + 1, 0) : b] = False
    valid = np.flatnonzero(ok)
    if not len(valid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    anchor = at[valid]
    new = np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(valid) != 1)])
    first = np.flatnonzero(new)
    return valid[first], np.diff(np.append(first, len(valid))), grams[anchor[first]]


# ------------------------------------------------------------ chunks of rows


def _pack(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _bytes_of(table: pa.Table, text: str) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and where each begins (one end more)."""
    raw = [b"" if t is None else t.encode("utf-8", "replace") for t in table.column(text).to_pylist()]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])


CHUNK_SCHEMA = "chunk bigint, rows binary, bucket int, anchors binary, runs binary"


def _chunker(text: str, buckets: int):
    schema = pa.schema([("chunk", pa.int64()), ("rows", pa.binary()), ("bucket", pa.int32()), ("anchors", pa.binary()), ("runs", pa.binary())])

    def close(chunk: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        data, at = _bytes_of(table, text)
        start, size, h = runs_of(data, at)
        # a distinct anchor each; its lowest bit tells that this chunk has several runs
        # of it, and then the number of different ones goes along
        h |= np.uint64(1)
        same = mix(h ^ Rolling(data).of(start, start + size + WINDOW - 1))
        different = h[np.unique(same, return_index=True)[1]]
        h, n = np.unique(h, return_counts=True)
        runs = np.unique(different, return_counts=True)[1]
        bucket = (mix(h) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        several = n[order] > 1
        h, runs = np.where(several, h[order], h[order] ^ np.uint64(1)), runs[order].astype(np.uint32)
        parts = [(b, slice(cuts[b], cuts[b + 1])) for b in range(buckets) if cuts[b] < cuts[b + 1]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([chunk] * (len(parts) + 1), pa.int64()),
                pa.array([_pack(batches)] + [None] * len(parts), pa.binary()),
                pa.array([None] + [b for b, _ in parts], pa.int32()),
                pa.array([None] + [h[p].tobytes() for _, p in parts], pa.binary()),
                pa.array([None] + [runs[p][several[p]].tobytes() for _, p in parts], pa.binary()),
            ],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lean("suffix")
        chunk, held, size = TaskContext.get().partitionId() << 24, [], 0
        for b in batches:
            held.append(b)
            size += b.column(b.schema.get_field_index(text)).nbytes
            if size >= CHUNK_BYTES:
                yield close(chunk, held)
                chunk, held, size = chunk + 1, [], 0
        if held:
            yield close(chunk, held)

    return run


def _again(table: pa.Table) -> pa.Table:
    """Of a bucket: each chunk's anchors that occur more than once in the corpus; the
    lowest bit of an anchor tells that it is hot."""
    chunks = table.column("chunk").to_pylist()
    blocks = [np.frombuffer(x, dtype=np.uint64) for x in table.column("anchors").to_pylist()]
    all_ = np.concatenate(blocks)
    key, several = all_ | np.uint64(1), (all_ & np.uint64(1)).astype(bool)
    runs = np.ones(len(all_), dtype=np.int64)
    runs[several] = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in table.column("runs").to_pylist()])
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], np.diff(key[order]) != 0])
    group = np.cumsum(new) - 1
    many = np.bincount(group, 1 + several[order]) > 1
    hot = np.bincount(group, runs[order]) > HOT_RUNS
    keep, marked = np.empty(len(all_), dtype=bool), np.empty(len(all_), dtype=np.uint64)
    keep[order] = many[group]
    marked[order] = np.where(hot[group], key[order], key[order] ^ np.uint64(1))
    out, at = [], 0
    for b in blocks:
        out.append(marked[at : at + len(b)][keep[at : at + len(b)]].tobytes())
        at += len(b)
    return pa.table({"of_chunk": pa.array(chunks, pa.int64()), "anchors": pa.array(out, pa.binary())})


# A block holds what one chunk sends to one bucket: arrays as bytes, texts compressed
# together.  Blocks without texts are spans of repeats that are known already.
BLOCKS = "bucket int, chunk bigint, rows binary, docs binary, starts binary, sizes binary, n_bytes bigint, texts binary"
SPANS = "of_chunk bigint, rows binary, starts binary, lasts binary"


def _blocks(found: list[tuple]) -> pa.Table:
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
    cols = list(zip(*found, strict=True)) if found else [[] for _ in types]
    return pa.table({n.split()[0]: pa.array(c, ty) for n, c, ty in zip(BLOCKS.split(", "), cols, types, strict=True)})


def _spans(found: list[tuple]) -> pa.Table:
    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    cols = list(zip(*found, strict=True)) if found else [[] for _ in types]
    return pa.table({n.split()[0]: pa.array(c, ty) for n, c, ty in zip(SPANS.split(", "), cols, types, strict=True)})


def _emit_runs(text: str, doc_id: str, parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lean("suffix")
        if not left.num_rows or not right.num_rows:
            return _blocks([])
        chunk = left.column("chunk")[0].as_py()
        rows = _unpack(left.column("rows")[0].as_py())
        wanted = np.sort(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in right.column("anchors").to_pylist()]))
        if not len(wanted):
            return _blocks([])
        data, at = _bytes_of(rows, text)
        start, size, h = runs_of(data, at)
        key = h | np.uint64(1)
        place = np.minimum(np.searchsorted(wanted | np.uint64(1), key), len(wanted) - 1)
        again = (wanted[place] | np.uint64(1)) == key
        start, size, key, hot = start[again], size[again], key[again], (wanted[place[again]] & np.uint64(1)).astype(bool)
        if not len(start):
            return _blocks([])
        end = start + size + WINDOW - 1
        row = np.searchsorted(at, start, side="right") - 1
        number = np.array([-(1 << 63) if i is None else i for i in rows.column(doc_id).to_pylist()], dtype=np.int64)
        # equal runs of this chunk: 128 bits of hash and the length
        roll = Rolling(data)
        one, two = roll.of(start, end), Rolling(data, _BASE_2).of(start, end)
        first, later = _earliest((one, two, size), (start, row, number[row]))
        out = []
        if len(later):
            inside = start[later] - at[row[later]]
            s, e = _joined(inside, inside + size[later] - 1, row[later])
            lasts = (inside + size[later] - 1)[e]
            out.append((int(chunk % parts), chunk, row[later][s].astype(np.int32).tobytes(), None, inside[s].tobytes(), lasts.tobytes(), 0, None))
        # a hot anchor's runs go out window by window, dealt by all bytes of the window;
        # of equal windows of this chunk the earliest, the others are repeats already
        hot_runs, plain = first[hot[first]], first[~hot[first]]
        w = np.repeat(start[hot_runs], size[hot_runs]) + _counts(size[hot_runs])
        w_row, w_hash = np.repeat(row[hot_runs], size[hot_runs]), roll.of(w, w + WINDOW)
        if len(w):
            once, later = _earliest((w_hash, Rolling(data, _BASE_2).of(w, w + WINDOW)), (w, w_row, number[w_row]))
            if len(later):
                inside = w[later] - at[w_row[later]]
                s, e = _joined(inside, inside, w_row[later])
                out.append((int(chunk % parts), chunk, w_row[later][s].astype(np.int32).tobytes(), None, inside[s].tobytes(), inside[e].tobytes(), 0, None))
            w, w_row, w_hash = w[once], w_row[once], w_hash[once]
        start = np.concatenate([start[plain], w])
        end = np.concatenate([end[plain], w + WINDOW])
        row = np.concatenate([row[plain], w_row])
        to = np.concatenate([mix(key[plain]), w_hash]) % np.uint64(parts)
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(to[order]) != 0]))
        raw = data.tobytes()
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            i = order[a:b]
            texts = b"".join([raw[x:y] for x, y in zip(start[i].tolist(), end[i].tolist(), strict=True)])
            packed = pa.compress(texts, codec="zstd", asbytes=True)
            out.append(
                (int(to[i[0]]), chunk, row[i].astype(np.int32).tobytes(), number[row[i]].tobytes(), (start[i] - at[row[i]]).tobytes(),
                 (end[i] - start[i]).tobytes(), len(texts), packed)
            )
        return _blocks(out)

    return run


def _earliest(values: tuple[np.ndarray, ...], place: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of items with equal ``values`` the one that comes first, and all the others;
    ``place`` as for ``lexsort``, the deciding part last."""
    order = np.lexsort((*place, *values))
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for v in values:
        new[1:] |= v[order][1:] != v[order][:-1]
    return np.sort(order[new]), np.sort(order[~new])


def _counts(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. up to each size, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _joined(first: np.ndarray, last: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of windows that follow each other begin and end; sorted input."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], (first[1:] != last[:-1] + 1) | (owner[1:] != owner[:-1])])
    begin = np.flatnonzero(new)
    return begin, np.append(begin[1:], len(first)) - 1


def repeats_in(texts: list[bytes], owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, window)`` of all windows of which an equal one comes earlier.

    Window ``w`` of text ``i`` stands at ``start[i] + w`` of row ``owner[i]``; rows
    are numbered in document order.
    """
    size = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum(size)])
    text = np.repeat(np.arange(len(texts)), size - WINDOW + 1)
    window = np.arange(len(text)) - np.repeat(np.cumsum(size - WINDOW + 1) - (size - WINDOW + 1), size - WINDOW + 1)
    h = Rolling(data).every(WINDOW)[at[text] + window]
    # texts none of whose windows has a twin, by hash, need no sorting; of the others
    # what counts is from the first twin to the end of the last
    first, last = _stretch(text, window, _twins(h), len(texts))
    kept = np.flatnonzero(last >= 0)
    if not len(kept):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = (owner.astype(np.int64) << 32) + start
    kept = kept[np.argsort(place[kept] + first[kept], kind="stable")]
    seen: dict[bytes, int] = {}
    alone, copies = [], []
    for i in kept.tolist():  # equal stretches, byte by byte: all but the earliest are repeats
        if seen.setdefault(texts[i][first[i] : last[i] + WINDOW], i) == i:
            alone.append(i)
        else:
            copies.append(i)
    out_text, out_window = [], []
    if copies:
        c = np.array(copies)
        n = last[c] - first[c] + 1
        out_text.append(np.repeat(c, n))
        out_window.append(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[c], n))
    # twins among the stretches that are left
    is_alone = np.zeros(len(texts), dtype=bool)
    is_alone[alone] = True
    inside = is_alone[text] & (window >= first[text]) & (window <= last[text])
    text, window = text[inside], window[inside]
    first, last = _stretch(text, window, _twins(h[inside]), len(texts))
    mixed = np.flatnonzero(last >= 0)
    if len(mixed):
        t, w = _sorted_repeats([texts[i][first[i] : last[i] + WINDOW] for i in mixed], place[mixed] + first[mixed])
        out_text.append(mixed[t])
        out_window.append(w + first[mixed[t]])
    if not out_text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_text), np.concatenate(out_window)


def _twins(h: np.ndarray) -> np.ndarray:
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twin = np.zeros(len(h), dtype=bool)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    return twin


def _stretch(text: np.ndarray, window: np.ndarray, chosen: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last chosen window of each text (last -1: none)."""
    first, last = np.full(n, 1 << 62), np.full(n, -1)
    np.minimum.at(first, text[chosen], window[chosen])
    np.maximum.at(last, text[chosen], window[chosen])
    return first, last


def _sorted_repeats(cut: list[bytes], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(text, window)`` of the windows of which an equal one has a smaller place."""
    size = np.array([len(t) for t in cut], dtype=np.int64)
    data = np.frombuffer(b"".join(cut) + b"\0" * 8, dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum(size)])
    order = suffix_order(data[: at[-1]].astype(np.int64) + 1, WINDOW)
    which = np.repeat(np.arange(len(cut)), size)[order]
    is_window = order - at[which] <= size[which] - WINDOW
    order, which = order[is_window], which[is_window]
    words = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    differ = np.zeros(len(order), dtype=bool)
    differ[0] = True
    for j in [*range(0, WINDOW - 8, 8), WINDOW - 8]:
        w = words[order + j]
        differ[1:] |= w[1:] != w[:-1]
    group = np.flatnonzero(differ)
    window = order - at[which]
    where = place[which] + window
    later = where != np.repeat(np.minimum.reduceat(where, group), np.diff(np.append(group, len(where))))
    return which[later], window[later]


def _sort_bucket(table: pa.Table) -> pa.Table:
    lean("suffix")
    out, texts, cols = [], [], []
    for b in table.to_pylist():
        rows, starts, sizes = np.frombuffer(b["rows"], np.int32), np.frombuffer(b["starts"], np.int64), np.frombuffer(b["sizes"], np.int64)
        if b["texts"] is None:
            out.append((b["chunk"], b["rows"], b["starts"], b["sizes"]))
            continue
        raw = pa.decompress(b["texts"], decompressed_size=b["n_bytes"], codec="zstd", asbytes=True)
        ends = np.cumsum(sizes).tolist()
        texts += [raw[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        cols.append((np.frombuffer(b["docs"], np.int64), np.full(len(rows), b["chunk"]), rows.astype(np.int64), starts))
    if not texts:
        return _spans(out)
    doc, chunk, row, start = (np.concatenate(c) for c in zip(*cols, strict=True))
    order = np.lexsort((row, chunk, doc))
    new = np.concatenate([[False], (np.diff(doc[order]) != 0) | (np.diff(chunk[order]) != 0) | (np.diff(row[order]) != 0)])
    owner = np.empty(len(order), dtype=np.int64)
    owner[order] = np.cumsum(new)
    text, window = repeats_in(texts, owner, start)
    at = start[text] + window
    order = np.lexsort((at, row[text], chunk[text]))
    text, at = text[order], at[order]
    b, e = _joined(at, at, owner[text])
    to, rows, starts, lasts = chunk[text[b]], row[text[b]].astype(np.int32), at[b], at[e]
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(to) != 0])).tolist() if len(to) else []
    for x, y in zip(cuts, [*cuts[1:], len(to)], strict=False):
        out.append((int(to[x]), rows[x:y].tobytes(), starts[x:y].tobytes(), lasts[x:y].tobytes()))
    return _spans(out)


# ------------------------------------------------------------ on Spark


class Repeats:
    """The stored chunks of a table and the spans of repeats in them."""

    def __init__(self, chunks: DataFrame, spans: DataFrame, schema: T.StructType, text: str):
        self.chunks, self.spans, self.schema, self.text = chunks, spans, schema, text

    def apply(self, step, schema: str | T.StructType) -> DataFrame:
        """``step(rows, begins, ends, owners)`` for each chunk: its rows as an Arrow
        table and the merged spans (bytes, end exclusive) with their row numbers."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = _unpack(left.column("rows")[0].as_py())
            kinds = {"rows": np.int32, "starts": np.int64, "lasts": np.int64}
            r, a, z = (np.concatenate([np.zeros(0, k), *[np.frombuffer(x, k) for x in right.column(c).to_pylist()]]) for c, k in kinds.items())
            order = np.lexsort((a, r))
            r, a, z = r[order].astype(np.int64), a[order], z[order] + WINDOW
            far = np.maximum.accumulate(z + (r << 40)) - (r << 40) if len(r) else z
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (a[1:] > far[:-1])]) if len(r) else np.zeros(0, bool)
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(r)) - 1 if len(r) else begin
            return step(rows, a[begin], far[end] if len(r) else a, r[begin])

        return self.chunks.groupBy("chunk").cogroup(self.spans.groupBy("of_chunk")).applyInArrow(run, schema)


def find_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Repeats:
    """All repeated windows of the texts, as spans by stored chunk."""
    docs = docs.withColumn(doc_id, F.col(doc_id).cast("bigint"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-size // (BUCKET_ANCHORS * (WINDOW - GRAM + 1) // 2)))
    stored = materialize(docs.mapInArrow(_chunker(text, buckets), CHUNK_SCHEMA), "chunks")
    chunks = stored.filter("rows IS NOT NULL").select("chunk", "rows")
    anchors = stored.filter("anchors IS NOT NULL").select("bucket", "chunk", "anchors", "runs")
    again = anchors.groupBy("bucket").applyInArrow(_again, "of_chunk bigint, anchors binary")
    parts = size // BUCKET_BYTES + 1
    blocks = chunks.groupBy("chunk").cogroup(again.groupBy("of_chunk")).applyInArrow(_emit_runs(text, doc_id, parts), BLOCKS)
    spans = materialize(blocks.groupBy("bucket").applyInArrow(_sort_bucket, SPANS), "spans")
    return Repeats(chunks, spans, docs.schema, text)


def _marks(raw_size: int, begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The stretches that stay."""
    out, at = [], 0
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        if a > at:
            out.append((at, a))
        at = b
    if at < raw_size:
        out.append((at, raw_size))
    return out


def per_row(rows: pa.Table, text: str, begins: np.ndarray, ends: np.ndarray, owners: np.ndarray) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Each row's bytes with the spans that are cut out of it."""
    cut = np.searchsorted(owners, np.arange(rows.num_rows + 1))
    for i, t in enumerate(rows.column(text).to_pylist()):
        raw = b"" if t is None else t.encode("utf-8", "replace")
        yield raw, begins[cut[i] : cut[i + 1]], ends[cut[i] : cut[i + 1]]


def kept_bytes(raw: bytes, begins: np.ndarray, ends: np.ndarray) -> bytes:
    return b"".join(raw[a:b] for a, b in _marks(len(raw), begins, ends))


def cut_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the repeats cut out of ``text``; a character is only cut whole."""
    given = docs.schema
    found = find_repeats(docs, text)

    def whole(raw: bytes, a: int, b: int) -> tuple[int, int]:
        while a < b and (raw[a] & 0xC0) == 0x80:  # inside a character: it stays
            a += 1
        while b > a and b < len(raw) and (raw[b] & 0xC0) == 0x80:
            b -= 1
        return a, b

    def step(rows: pa.Table, begins: np.ndarray, ends: np.ndarray, owners: np.ndarray) -> pa.Table:
        out = []
        for (raw, a, b), old in zip(per_row(rows, text, begins, ends, owners), rows.column(text).to_pylist(), strict=True):
            if not len(a):
                out.append(old)
                continue
            inner = [whole(raw, x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            out.append(kept_bytes(raw, np.array([x for x, _ in inner]), np.array([y for _, y in inner])).decode("utf-8"))
        i = rows.schema.get_field_index(text)
        return rows.set_column(i, rows.schema.field(i), pa.array(out, rows.schema.field(i).type))

    done = found.apply(step, found.schema)
    return done.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in given])
