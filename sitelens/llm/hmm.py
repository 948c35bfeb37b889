"""Hidden Markov language model trained by Baum-Welch on Spark.

Tokens are words (runs of bytes other than blank, tab, LF, VT, FF, CR; A-Z
lower-cased) and one end token a text.  The model emits *classes*: the ``TOP``
most frequent training words and the end token are a class each, all other words
fall into ``TAIL`` classes by a hash of their last bytes, and a word of a tail
class is drawn from the class by its smoothed count::

    P(text) = P_hmm(class_1 .. class_n) * prod (c + a) / (N_k + a (V_k + 1))

So the model has ``STATES x (1 + TOP + TAIL)`` numbers at any corpus size, while
the word counts behind it are those of the whole training corpus.

Steps:

1. *Chunks.*  Every task reads its texts once and writes, for about
   ``CHUNK_TOKENS`` tokens at a time, the texts as local word numbers and the
   chunk's own dictionary with training counts (combined before any shuffle).
2. *Counts.*  Chunk dictionaries are summed by word: ``c``, ``N``, ``V``, the top
   words, and ``N_k, V_k`` of the tail classes.
3. *Resolving.*  Joined back by word, a chunk's dictionary meets the chunk's texts:
   a group is one chunk, which is bounded, whatever words are frequent.  The
   result has each text as class numbers, its base score and its tail score.
4. *Baum-Welch.*  Tasks run the scaled forward-backward recursion over their
   training texts and emit expected counts; Spark sums them by entry, and the
   driver gets one number for each entry of the model.
5. *Scoring.*  Forward recursion with scaling over every whole text: exact.

Defined cases: null text is empty and has its end token only; a null doc_id hashes
as the empty string; repeated rows are counted and scored each; without training
rows every count is 0 and the model is uniform; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import materialize, text_or_empty

CHUNK_TOKENS = 3_000_000
TOP, TAIL, TAIL_BYTES = 4096, 512, 3
STATES, ROUNDS = 6, 4
ADD = 0.1
BATCH_TOKENS = 600_000  # tokens that one recursion holds at a time
LONG = 1500  # tokens from which texts are recursed among themselves

CHUNKS = "chunk bigint, doc_id bigint, held_out boolean, words binary, word binary, local int, n bigint"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    schema = pa.schema(
        [("chunk", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("words", pa.binary()), ("word", pa.binary()), ("local", pa.int32()), ("n", pa.int64())]
    )

    def batch(rows: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[f.name], type=f.type) if f.name in cols else pa.nulls(rows, f.type) for f in schema], schema=schema
        )

    def fresh():
        return defaultdict(count().__next__), [], 0

    base, number = TaskContext.get().partitionId() << 24, 0
    local, trained, tokens = fresh()

    def close() -> Iterator[pa.RecordBatch]:
        n = np.bincount(np.concatenate(trained) if trained else np.zeros(0, np.int64), minlength=len(local))
        names, step = list(local), 100_000
        for a in range(0, len(names), step):
            part = names[a : a + step]
            yield batch(len(part), chunk=np.full(len(part), base + number), word=part, local=np.arange(a, a + len(part), dtype=np.int32), n=n[a : a + len(part)])

    for b in batches:
        docs, held, seqs, at = [], [], [], []
        for doc_id, is_held, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
            ids = np.fromiter(map(local.__getitem__, text.encode("utf-8", "replace").lower().split()), dtype=np.int32)
            if not is_held:
                trained.append(ids)
            docs.append(doc_id)
            held.append(is_held)
            seqs.append(ids.tobytes())
            at.append(base + number)
            tokens += len(ids)
            if tokens >= CHUNK_TOKENS:
                yield from close()
                number += 1
                local, trained, tokens = fresh()
        if docs:
            yield batch(len(docs), chunk=at, doc_id=docs, held_out=held, words=seqs)
    yield from close()


@dataclass(frozen=True)
class Counts:
    """Corpus totals; ``ends`` is the count of the end token."""

    n: int
    v: int
    ends: int


def word_class(rank: Column, word: Column, top: int, tail: int) -> Column:
    by_end = F.pmod(F.xxhash64(F.substring(word, -TAIL_BYTES, TAIL_BYTES)), F.lit(tail)).cast("int")
    return F.when(rank.isNotNull(), rank).otherwise(by_end + 1 + top)


def read_corpus(docs: DataFrame, held_out: Column, top: int = TOP, tail: int = TAIL) -> tuple[DataFrame, Counts]:
    """Steps 1 to 3: ``doc_id, held_out, classes, n_known, base_score, tail_score`` and totals."""
    cols = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), text_or_empty().alias("text"))
    stored = materialize(cols.mapInArrow(_chunks, CHUNKS), "chunks")
    texts = stored.filter("word IS NULL").select("chunk", "doc_id", "held_out", "words")
    used = stored.filter("word IS NOT NULL").select("chunk", "word", "local", "n")

    words = materialize(used.groupBy("word").agg(F.sum("n").alias("c")), "words")
    ends = texts.filter(~F.col("held_out")).count()
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    totals = Counts(total["n"] + ends, total["v"] + (ends > 0), ends)
    # at most ``top`` rows, so this table is small at any size
    best = words.filter("c > 0").orderBy(F.desc("c"), "word").limit(top).collect()
    ranks = words.sparkSession.createDataFrame([(r["word"], i + 1) for i, r in enumerate(best)], "word binary, rank int")
    classed = words.join(F.broadcast(ranks), "word", "left").select(
        "word", "c", word_class(F.col("rank"), F.col("word"), top, tail).alias("class")
    )
    in_class = classed.filter(F.col("class") > top).groupBy("class").agg(F.sum("c").alias("n_k"), F.count_if(F.col("c") > 0).alias("v_k"))
    # one row a tail class: at most ``tail`` rows
    scored = classed.join(F.broadcast(in_class), "class", "left").select(
        "word", "c", "class",
        F.when(F.col("class") > top, F.log10((F.col("c") + ADD) / (F.col("n_k") + ADD * (F.col("v_k") + 1)))).otherwise(F.lit(0.0)).alias("tail"),
    )
    known = used.join(scored, "word").select(F.col("chunk").alias("of_chunk"), "local", "c", "class", "tail")
    out = texts.groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInPandas(
        _resolve(totals), "doc_id bigint, held_out boolean, classes binary, n_known bigint, base_score double, tail_score double"
    )
    return materialize(out, "classes"), totals


def _resolve(totals: Counts):
    floor = np.log10(totals.n + ADD * (totals.v + 1))
    end = np.log10(totals.ends + ADD) - floor

    def run(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(known["local"].to_numpy())
        c = known["c"].to_numpy(np.int64)[order]
        cls = known["class"].to_numpy(np.int64)[order].astype(np.uint16)
        tail = known["tail"].to_numpy(float)[order]
        base = np.log10(c + ADD) - floor
        rows = []
        for doc_id, held, words in zip(texts["doc_id"], texts["held_out"], texts["words"], strict=True):
            w = np.frombuffer(words, dtype=np.int32)
            classes = np.append(cls[w], np.uint16(0)).tobytes()
            rows.append((doc_id, held, classes, int((c[w] > 0).sum()) + (totals.ends > 0), base[w].sum() + end, tail[w].sum()))
        return pd.DataFrame(rows, columns=["doc_id", "held_out", "classes", "n_known", "base_score", "tail_score"])

    return run


# ------------------------------------------------------------ the model


@dataclass
class Hmm:
    start: np.ndarray  # S
    move: np.ndarray  # S x S
    emit: np.ndarray  # S x M

    @staticmethod
    def initial(freq: np.ndarray, states: int, seed: int = 7) -> Hmm:
        """Sticky states; emissions are the class frequencies, perturbed."""
        rng = np.random.default_rng(seed)
        emit = (freq + 0.5) * np.exp(rng.normal(0, 0.7, (states, len(freq))))
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return Hmm(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @staticmethod
    def from_counts(v: np.ndarray, states: int, freq: np.ndarray) -> Hmm:
        m = len(freq)
        start, move, emit = v[:states], v[states : states + states * states].reshape(states, states), v[states * (states + 1) :].reshape(states, m)
        prior = (freq + 0.5) / (freq + 0.5).sum()
        start, move, emit = start + 0.1, move + 0.1, emit + 10 * prior
        return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _lay_out(texts: list[np.ndarray]):
    """Texts longest first, position by position: class numbers of all texts at
    position 0, then at 1, ...; and where each position begins."""
    size = np.array([len(t) for t in texts])
    order = np.argsort(-size, kind="stable")
    size = size[order]
    width = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts that reach a position
    starts = np.concatenate([[0], np.cumsum(width)])
    flat = np.empty(starts[-1], dtype=np.int64)
    for rank, i in enumerate(order):
        flat[starts[: size[rank]] + rank] = texts[i]
    return order, size, width, starts, flat


def forward(texts: list[np.ndarray], model: Hmm):
    """Scaled forward recursion: layout, emissions, alphas, scales."""
    order, size, width, starts, flat = _lay_out(texts)
    seen = np.ascontiguousarray(model.emit.T)[flat]
    alpha = np.empty_like(seen)
    scale = np.empty(len(flat))
    a = model.start * seen[: width[0]]
    for t in range(len(width)):
        lo, hi = starts[t], starts[t + 1]
        if t:
            a = (a[: width[t]] @ model.move) * seen[lo:hi]
        s = a.sum(1)
        a /= s[:, None]
        alpha[lo:hi] = a
        scale[lo:hi] = s
    return order, size, width, starts, flat, seen, alpha, scale


def log10_likelihood(texts: list[np.ndarray], model: Hmm) -> np.ndarray:
    order, size, width, starts, _, _, _, scale = forward(texts, model)
    logs = np.log10(scale)
    rank = np.arange(len(logs)) - np.repeat(starts[:-1], width)
    out = np.empty(len(texts))
    out[order] = np.bincount(rank, logs, len(texts))
    return out


def expected_counts(texts: list[np.ndarray], model: Hmm) -> np.ndarray:
    """Start, move and emit counts under the model, as one vector."""
    order, size, width, starts, flat, seen, alpha, scale = forward(texts, model)
    states, m = model.emit.shape
    beta = np.ones_like(alpha)
    back = model.move.T.copy()
    for t in range(len(width) - 2, -1, -1):
        lo, hi, n = starts[t + 1], starts[t + 2], width[t + 1]
        beta[starts[t] : starts[t] + n] = (beta[lo:hi] * seen[lo:hi] / scale[lo:hi, None]) @ back
    gamma = alpha * beta
    later = np.arange(starts[1], starts[-1])
    rank = np.arange(len(flat)) - np.repeat(starts[:-1], width)
    before = np.repeat(starts[:-2], width[1:]) + rank[later]
    move = model.move * (alpha[before].T @ (beta[later] * seen[later] / scale[later, None]))
    emit = np.stack([np.bincount(flat, gamma[:, k], m) for k in range(states)])
    return np.concatenate([gamma[: width[0]].sum(0), move.ravel(), emit.ravel()])


def _groups(rows: Iterator[tuple[object, np.ndarray]]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Texts in groups of about ``BATCH_TOKENS``, long ones among themselves."""
    held = {False: ([], [], 0), True: ([], [], 0)}
    for key, t in rows:
        is_long = len(t) > LONG
        keys, texts, n = held[is_long]
        keys.append(key)
        texts.append(t)
        n += len(t)
        if n >= BATCH_TOKENS:
            yield keys, texts
            keys, texts, n = [], [], 0
        held[is_long] = (keys, texts, n)
    for keys, texts, _ in held.values():
        if keys:
            yield keys, texts


def _texts(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, np.ndarray]]:
    for b in batches:
        for k, t in zip(b.column(key).to_pylist(), b.column("classes").to_pylist(), strict=True):
            yield k, np.frombuffer(t, dtype=np.uint16)


def train(corpus: DataFrame, states: int = STATES, rounds: int = ROUNDS, classes: int = 1 + TOP + TAIL) -> Hmm:
    """Baum-Welch over all rows that are not held out."""
    rows = corpus.filter(~F.col("held_out")).select("held_out", "classes")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(classes)
        for _, t in _texts(batches, "held_out"):
            n += np.bincount(t, minlength=classes)
        yield _entries(n)

    freq = _summed(rows, tally, classes)
    model = Hmm.initial(freq, states)
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], model: Hmm = model) -> Iterator[pa.RecordBatch]:
            n = np.zeros(states * (1 + states + classes))
            for _, texts in _groups(_texts(batches, "held_out")):
                n += expected_counts(texts, model)
            yield _entries(n)

        model = Hmm.from_counts(_summed(rows, expect, states * (1 + states + classes)), states, freq)
    return model


def _entries(v: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(v > 1e-9)
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(v[at])], names=["at", "v"])


def _summed(rows: DataFrame, step, size: int) -> np.ndarray:
    """Sums by entry over all tasks; the driver gets at most ``size`` numbers."""
    out = np.zeros(size)
    for r in rows.mapInArrow(step, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def score(corpus: DataFrame, model: Hmm) -> DataFrame:
    """Add ``n_tokens`` and ``score``, the log10 probability, to every row."""
    carried = ["doc_id", "held_out", "n_known", "base_score", "tail_score"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                given = list(zip(*(b.column(c).to_pylist() for c in carried), strict=True))
                for g, t in zip(given, b.column("classes").to_pylist(), strict=True):
                    yield g, np.frombuffer(t, dtype=np.uint16)

        for keys, texts in _groups(rows()):
            logs = log10_likelihood(texts, model)
            cols = [pa.array(list(c), type=ty) for c, ty in zip(zip(*keys, strict=True), types, strict=True)]
            tails = np.array([k[4] for k in keys])
            n = pa.array(np.array([len(t) for t in texts], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*cols[:4], n, pa.array(logs + tails)], names=[*carried[:4], "n_tokens", "score"])

    return corpus.select(*carried, "classes").mapInArrow(
        run, "doc_id bigint, held_out boolean, n_known bigint, base_score double, n_tokens bigint, score double"
    )
