"""Hard negatives by rotated one-bit codes with exact intervals.

For every anchor the positives are its best-scored rows of the same label, and for
every positive the negatives are the best-scored rows of another label whose score
lies between two percentages of the positive's.  Scores are integer inner products
of integer vectors, so the result is exact and has no ties but those by ``vec_id``.

Codes.  A vector ``x`` is rotated (random signs, then the Walsh-Hadamard matrix, so
integers stay integers) and the signs of its coordinates are its one-bit code: a
unit vector ``u`` in the rotated space.  Stored beside the code are the alignment
``a = <x, u>`` and the length of the residual ``r = x - a u``.  ``LEVELS`` such codes
are kept, each with a rotation of its own, of what the code before has left.  For a
query ``q``::

    <q, x> = sum_l a_l <q, u_l> + <q, r>,   |<q, r>| <= sqrt(|q|^2 - <q, u_L>^2) |r|

since the last residual is orthogonal to the last code (Cauchy-Schwarz).  The
``<q, u_l>`` are exact: the rotated query is cut into bit planes, and each plane is
met with the code by AND and popcount.  A row whose interval lies below the scores
already found, or outside the percentages, is dropped without a look at its vector;
what remains is scored in integers.  Intervals are widened by more than the rounding
of their few float operations, so no row is lost.

Plan.  Rows are packed, with their codes, into blocks of at most ``BLOCK_ROWS``;
anchors into blocks of about ``ANCHOR_ROWS``.  Every anchor block meets every row
block in one of ``cells`` groups of row blocks (an equi-join on block and cell), and
a cell keeps the best few of each anchor; cells are merged by a sort of at most
``cells`` times that many rows an anchor.  Positives come first, then the anchors
return with their positives' scores for the negatives.

Defined cases: rows with a null id, label or vector, or with a null or non-finite
component, take no part, nor do those with a scaled component of ``2**23`` and more, whose
products (times 100) could leave 64 bits; shorter vectors count as padded with zeros; of rows
that repeat a ``vec_id`` the smallest (label, vector) counts; an anchor without
another row of its label has no rows in the result; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import materialize

LEVELS = 4
BLOCK_ROWS, STEP_ROWS, TILE_ANCHORS = 4096, 512, 64
ANCHOR_ROWS = 1024
PAIRS = 40_000  # vector pairs scored at a time
LIMIT = 1 << 23
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max

_ROW_BLOCK = "block bigint, ids binary, labels binary, vectors binary, codes binary, align binary, rest binary, norm binary"
_FOUND = "anchor_id bigint, positive_id bigint, positive_score bigint, vec_id bigint, score bigint"


# ------------------------------------------------------------------ vectors


def integer_vectors(rows: DataFrame, vec: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, label, vector``: rows that take part, components ``floor(scale * x)``."""
    x = F.col(vec).cast("array<double>")
    fit = F.forall(x, lambda c: F.coalesce(F.abs(c * scale) < float(LIMIT), F.lit(False)))  # false for NaN too
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vec).isNotNull() & fit
    return rows.filter(usable).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("vector"),
    )


# ------------------------------------------------------------------ codes


@lru_cache(maxsize=16)
def signs(level: int, width: int) -> np.ndarray:
    return np.random.default_rng(1_000 + level).integers(0, 2, width) * 2 - 1


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; integers stay integers."""
    n, width = x.shape
    half = 1
    while half < width:
        x = x.reshape(n, -1, 2, half)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, width)
        half *= 2
    return x


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes ``[n, LEVELS, width/64]``, alignments, length of the last residual, length."""
    n, width = vectors.shape
    codes = np.zeros((n, LEVELS, width // 64), np.uint64)
    align = np.zeros((n, LEVELS))
    rest = vectors.astype(np.float64)
    norm = np.sqrt((rest * rest).sum(1))
    for level in range(LEVELS):
        s = signs(level, width)
        turned = hadamard(rest * s)
        bits = turned >= 0
        codes[:, level] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        align[:, level] = np.abs(turned).sum(1) / width
        unit = hadamard(np.where(bits, 1.0, -1.0)) * s / width
        rest = rest - align[:, level : level + 1] * unit
    return codes, align, np.sqrt((rest * rest).sum(1)), norm


class Queries:
    """Rotated queries as bit planes of their coordinates above the smallest one."""

    def __init__(self, vectors: np.ndarray):
        n, width = vectors.shape
        self.width = width
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        turned = np.stack([hadamard(vectors * signs(level, width)) for level in range(LEVELS)], axis=1)
        self.least, self.total = turned.min(2), turned.sum(2)
        above = (turned - self.least[:, :, None]).astype(np.uint64)
        self.planes = []
        for p in range(int(above.max(initial=0)).bit_length()):
            bits = (above >> np.uint64(p)) & np.uint64(1)
            self.planes.append(np.packbits(bits.astype(bool), axis=2, bitorder="little").view(np.uint64))

    def intervals(self, at: slice, codes, align, rest, norm) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the products of queries ``at`` with coded rows."""
        ones = np.bitwise_count(codes).sum(2, dtype=np.int64)
        estimate = 0.0
        for level in range(LEVELS):
            met = np.zeros((len(self.norm[at]), len(codes)), np.int64)
            for p, plane in enumerate(self.planes):
                count = 0
                for w in range(codes.shape[2]):
                    count = count + np.bitwise_count(plane[at, level, w, None] & codes[None, :, level, w]).astype(np.int64)
                met += count << p
            along = (2 * (met + self.least[at, level, None] * ones[None, :, level]) - self.total[at, level, None]) / self.width
            estimate = estimate + along * align[None, :, level]
        q = self.norm[at, None]
        wide = np.sqrt(np.maximum(q * q - along * along, 0.0)) * rest[None, :]
        wide += 1e-9 * q * norm[None, :] + 1e-6
        return estimate - wide, estimate + wide


# ------------------------------------------------------------------ blocks


def _packer(width: int, most: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            nonlocal number
            t = pa.Table.from_batches(held)
            vectors = dense(t.column("vector").combine_chunks(), width)
            # rows of a label stand together, so that positives are sought among them only
            order = np.lexsort((t.column("vec_id").to_numpy(), t.column("label").to_numpy()))
            parts = [t.column("vec_id").to_numpy()[order], t.column("label").to_numpy()[order], vectors[order].astype(np.int32), *encode(vectors[order])]
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), *[pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts]],
                names=["block", "ids", "labels", "vectors", "codes", "align", "rest", "norm"],
            )

        n = 0
        for b in batches:
            while b.num_rows:
                take = min(b.num_rows, most - n)
                held.append(b.slice(0, take))
                b, n = b.slice(take), n + take
                if n == most:
                    yield block()
                    held, n = [], 0
        if n:
            yield block()

    return pack


def dense(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column as integers, padded with zeros to ``width``."""
    sizes = column.value_lengths().to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(starts, sizes)] = column.flatten().to_numpy()
    return out


class RowBlock:
    def __init__(self, r: dict, width: int):
        self.ids, self.labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
        n = len(self.ids)
        self.vectors = np.frombuffer(r["vectors"], np.int32).reshape(n, width)
        self.codes = np.frombuffer(r["codes"], np.uint64).reshape(n, LEVELS, width // 64)
        self.align = np.frombuffer(r["align"]).reshape(n, LEVELS)
        self.rest, self.norm = np.frombuffer(r["rest"]), np.frombuffer(r["norm"])

    def coded(self, at: slice) -> tuple:
        return self.codes[at], self.align[at], self.rest[at], self.norm[at]


class Anchors:
    """An anchor block: queries, and for the second pass each one's positives."""

    def __init__(self, rows: list[dict], width: int):
        rows = sorted(rows, key=lambda r: (r["label"], r["vec_id"]))
        self.ids = np.array([r["vec_id"] for r in rows], np.int64)
        self.labels = np.array([r["label"] for r in rows], np.int64)
        self.vectors = dense(pa.array([r["vector"] for r in rows], pa.list_(pa.int32())), width)
        self.queries = Queries(self.vectors)
        self.positives = [r["positives"] or [] for r in rows]
        most = max([len(p) for p in self.positives], default=0)
        self.scores = np.full((len(rows), most), NONE)
        for k, p in enumerate(self.positives):
            self.scores[k, : len(p)] = [x["score"] for x in p]

    def score(self, a: np.ndarray, vectors: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), np.int64)
        for at in range(0, len(a), PAIRS):
            x, y = self.vectors[a[at : at + PAIRS]], vectors[b[at : at + PAIRS]]
            out[at : at + PAIRS] = np.einsum("ij,ij->i", x, y.astype(np.int64))
        return out


class Best:
    """The ``k`` best (score, id) of each of ``n`` lists."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.full((n, k), NONE), np.full((n, k), LAST)

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, which: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(which):
            return
        some = np.unique(which)
        which = np.concatenate((np.repeat(some, self.k), which))
        score = np.concatenate((self.score[some].ravel(), score))
        ids = np.concatenate((self.id[some].ravel(), ids))
        order = np.lexsort((ids, ~score, which))  # ~ reverses the order of integers without overflow
        which, score, ids = which[order], score[order], ids[order]
        rank = np.arange(len(which)) - np.searchsorted(which, which)
        keep = rank < self.k
        self.score[which[keep], rank[keep]] = score[keep]
        self.id[which[keep], rank[keep]] = ids[keep]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for w, r in zip(*np.nonzero(self.id != LAST), strict=True):
            yield int(w), int(self.id[w, r]), int(self.score[w, r])


def seek_positives(anchors: Anchors, block: RowBlock, best: Best, rows: int) -> None:
    """Adds to ``best`` (a list an anchor) the block's rows of the anchors' labels."""
    for label in np.unique(anchors.labels):
        a0, a1 = np.searchsorted(anchors.labels, (label, label + 1))
        r0, r1 = np.searchsorted(block.labels, (label, label + 1))
        for a in range(a0, a1, TILE_ANCHORS):
            tile = slice(a, min(a + TILE_ANCHORS, a1))
            for r in range(r0, r1, rows):
                step = slice(r, min(r + rows, r1))
                _, high = anchors.queries.intervals(tile, *block.coded(step))
                i, j = np.nonzero((high >= best.worst()[tile, None]) & (anchors.ids[tile, None] != block.ids[None, step]))
                i, j = i + a, j + r
                best.add(i, anchors.score(i, block.vectors, j), block.ids[j])


def seek_negatives(anchors: Anchors, block: RowBlock, best: Best, rows: int, low: int, high: int) -> None:
    """Adds to ``best`` (a list an anchor and positive) the block's rows of other labels
    with ``low * positive <= 100 * score <= high * positive``."""
    most = anchors.scores.shape[1]
    # the same bounds for scores, rounded inwards; none where the positive is absent or negative
    least, top = -((-low * anchors.scores) // 100), (high * anchors.scores) // 100
    least[anchors.scores < 0], top[anchors.scores < 0] = LAST, NONE
    for a in range(0, len(anchors.ids), TILE_ANCHORS):
        tile = slice(a, a + TILE_ANCHORS)
        for r in range(0, len(block.ids), rows):
            step = slice(r, r + rows)
            below, above = anchors.queries.intervals(tile, *block.coded(step))
            need = np.maximum(least[tile], best.worst().reshape(-1, most)[tile])
            may = np.zeros(below.shape, bool)
            for p in range(most):
                may |= (above >= need[:, p, None]) & (below <= top[tile, p, None])
            may &= anchors.labels[tile, None] != block.labels[None, step]
            i, j = np.nonzero(may)
            i, j = i + a, j + r
            score = anchors.score(i, block.vectors, j)
            for p in range(most):
                fit = (score >= least[i, p]) & (score <= top[i, p])
                best.add(i[fit] * most + p, score[fit], block.ids[j[fit]])


def _seeker(width: int, k: int, rows: int, bounds: tuple[int, int] | None = None):
    """Best rows of each anchor (or anchor and positive) within each run of a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = anchors = best = None

        def out() -> Iterator[pa.RecordBatch]:
            found = []
            for w, i, score in best.rows():
                if bounds is None:
                    found.append((int(anchors.ids[w]), None, None, i, score))
                else:
                    a, p = divmod(w, anchors.scores.shape[1])
                    pos = anchors.positives[a][p]
                    found.append((int(anchors.ids[a]), pos["vec_id"], pos["score"], i, score))
            if found:
                cols = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[c.split(" ")[0] for c in _FOUND.split(", ")])

        for b in batches:
            for k_row in range(b.num_rows):
                r = b.slice(k_row, 1)
                here = r.column("anchor_block")[0].as_py(), r.column("cell")[0].as_py()
                if here != cell:
                    if cell is not None:
                        yield from out()
                    anchors = Anchors(r.column("anchors")[0].as_py(), width)
                    best = Best(len(anchors.ids) * (1 if bounds is None else anchors.scores.shape[1]), k)
                    cell = here
                block = RowBlock({c: r.column(c)[0].as_py() for c in ("ids", "labels", "vectors", "codes", "align", "rest", "norm")}, width)
                if bounds is None:
                    seek_positives(anchors, block, best, rows)
                elif anchors.scores.shape[1]:
                    seek_negatives(anchors, block, best, rows, *bounds)
        if cell is not None:
            yield from out()

    return run


# ------------------------------------------------------------------ operator


def _meet(anchors: DataFrame, blocks: DataFrame, groups: int, cells: int, seeker) -> DataFrame:
    """Every anchor block with every row block, ``cells`` groups of row blocks each."""
    packed = anchors.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("anchor_block")).agg(
        F.collect_list(F.struct("vec_id", "label", "vector", "positives")).alias("anchors")
    )
    left = packed.select(F.col("anchor_block").cast("int"), "anchors", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    right = blocks.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("anchor_block"),
        F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int").alias("cell"), *[c for c in blocks.columns if c != "block"],
    )
    both = right.join(left, ["anchor_block", "cell"])
    return both.mapInArrow(seeker, _FOUND)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` are ``vec_id, label, vector`` as of ``integer_vectors``; ``is_anchor`` is a
    condition on ``vec_id``.  Anchors' positives are the first ``positives`` rows of
    their label; for each, the first ``negatives`` rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``.
    """
    spark = rows.sparkSession
    one = materialize(
        rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector"), "vectors"
    )
    longest = one.agg(F.max(F.size("vector"))).first()[0] or 1
    width = max(64, 1 << (longest - 1).bit_length())
    anchors = one.filter(is_anchor)
    groups = max(1, -(-anchors.count() // ANCHOR_ROWS))
    cells = max(1, -(-2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // groups))
    blocks = materialize(one.mapInArrow(_packer(width, BLOCK_ROWS), _ROW_BLOCK), "vector-blocks")

    no_positives = F.lit(None).cast("array<struct<vec_id:bigint,score:bigint>>").alias("positives")
    near = _meet(anchors.select("*", no_positives), blocks, groups, cells, _seeker(width, positives, STEP_ROWS))
    ranked = F.transform(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i")))), 1, positives),
        lambda x: F.struct(x["i"].alias("vec_id"), (-x["s"]).alias("score")),
    )
    chosen = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(ranked.alias("positives"))
    ready = materialize(anchors.join(chosen, "vec_id"), "anchors")

    far = _meet(ready, blocks, groups, cells, _seeker(width, negatives, STEP_ROWS, (low, high)))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i")))), 1, negatives)
    listed = far.groupBy("anchor_id", "positive_id", "positive_score").agg(best.alias("best"))
    return listed.select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("at", "n")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.i").alias("negative_id"),
        "positive_score", (-F.col("n.s")).alias("negative_score"),
    )
