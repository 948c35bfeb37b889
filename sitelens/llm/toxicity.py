"""Counterfactual-regularised toxicity classifier.

A logistic regression over word features (a word and its prefixes of 4 to 6
letters, present or not).  Besides the labels it sees *counterfactuals*: labelled
sentences that mention a group are repeated with the identity term swapped for
another of the same kind, and the squared change of the score is penalised, so
the mention itself carries no weight.  Minimised is

    mean log loss + L2 |w|^2 / 2 + SWAP * mean (w . (x' - x))^2 / 2.

Fitting uses at most ``max_rows`` labelled rows (those with the smallest hash of
their doc_id): the documented bound of the training sample.  Feature counts over
the sample are a Spark aggregation; only the ``max_features`` best features and
the sample's rows over them reach the driver.  Scoring covers every whole text,
task by task, with the weight table (at most ``max_features`` entries).

Defined cases: null text is empty and scores the intercept; labels that are null,
or whose document is missing, are ignored; a document labelled more than once is
toxic if any label says so; without labels of both kinds every score is the
smoothed share of toxic labels (a third if there are none); extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import fresh, lean, text_or_empty

MAX_ROWS = 30_000
MAX_FEATURES = 4_000
MIN_ROWS = 4  # labelled rows that a feature needs
MIN_Z = 4.0  # how far a feature's rates must lie apart, in standard errors
L2, SWAP, STEPS = 1e-4, 1.0, 400
PREFIXES = (4, 5, 6)
MEMO_WORDS = 200_000

#: Identity terms by kind; a term is only ever swapped within its kind.
IDENTITY = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "natives", "foreigners", "tourists"),
    ("old", "young", "elderly", "disabled"),
)

WORDS = re.compile(r"[^\W\d_]+").findall
SENTENCE = re.compile(r"[.!?\n]+").split


def word_features(w: str) -> list[str]:
    return [w, *(w[:n] + "*" for n in PREFIXES if len(w) >= n)]


def features(words) -> set[str]:
    return {f for w in words for f in word_features(w)}


def swaps(text: str, identity=IDENTITY) -> list[tuple[list[str], list[str]]]:
    """(lost, gained) features of each labelled sentence and swapped term."""
    kind = {t: k for k in identity for t in k}
    out = []
    for sentence in SENTENCE(text):
        words = WORDS(sentence)
        for term in sorted({w for w in words if w in kind}):
            same = kind[term]
            other = same[(same.index(term) + 1) % len(same)]
            before, after = features(words), features([other if w == term else w for w in words])
            out.append((sorted(before - after), sorted(after - before)))
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    intercept: float


def labelled_sample(docs: DataFrame, labels: DataFrame, allowed: Column | None, max_rows: int) -> DataFrame:
    """``text, y`` of at most ``max_rows`` labelled documents, one row an id."""
    wanted = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if allowed is not None:
        wanted = wanted.filter(allowed)
    ids = wanted.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # at most max_rows rows of two numbers, so this broadcast has a fixed bound; a row an
    # id, the one of smallest text, so rows that repeat an id don't pass the bound
    named = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")
    return named.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")


def _present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"y": pdf["y"], "f": [sorted(features(set(WORDS(t.lower())))) for t in pdf["text"]]})


def choose(sample: DataFrame, max_features: int, identity=IDENTITY) -> tuple[list[str], int, int]:
    """The features whose rates differ most, and the rows of each label."""
    n = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    total, pos = int(n["n"]), int(n["pos"])
    neg = total - pos
    if not pos or not neg:
        return [], pos, neg
    seen = sample.mapInPandas(_present, "y int, f array<string>").select("y", F.explode("f").alias("f"))
    counts = seen.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("t")).filter(F.col("n") >= MIN_ROWS)
    share = F.col("n") / F.lit(float(total))
    gap = F.col("t") / F.lit(float(pos)) - (F.col("n") - F.col("t")) / F.lit(float(neg))
    z = F.abs(gap) / F.sqrt(share * (F.lit(1.0) - share) * F.lit(1 / pos + 1 / neg) + F.lit(1e-12))
    terms = F.col("f").isin([t for k in identity for t in k])
    best = counts.filter((z >= MIN_Z) | terms).select("f", z.alias("z")).orderBy(F.desc("z"), "f").limit(max_features)
    return sorted(r["f"] for r in best.collect()), pos, neg


def _rows(vocabulary: list[str], identity):
    number = {f: i for i, f in enumerate(vocabulary)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ys, xs, changes = [], [], []
            for t, y in zip(pdf["text"], pdf["y"], strict=True):
                low = t.lower()
                ys.append(y)
                xs.append([number[f] for f in features(set(WORDS(low))) if f in number])
                change = []
                for lost, gained in swaps(low, identity):
                    d = [-number[f] - 1 for f in lost if f in number] + [number[f] + 1 for f in gained if f in number]
                    if d:
                        change.append(d)
                changes.append(change)
            yield pd.DataFrame({"y": ys, "x": xs, "d": changes})

    return run


class _Sparse:
    """Rows of a few columns each; enough linear algebra for gradient steps."""

    def __init__(self, rows: list[np.ndarray], values: list[np.ndarray] | None, columns: int):
        self.n, self.columns = len(rows), columns
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.concatenate(rows).astype(np.int64) if self.n else np.zeros(0, np.int64)
        self.val = np.concatenate(values) if values else np.ones(len(self.col))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * r[self.row], self.columns)


def descend(x: _Sparse, y: np.ndarray, d: _Sparse, l2: float = L2, swap: float = SWAP, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Adam on the full objective; returns weights and intercept."""
    w = np.zeros(x.columns + 1)
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w[:-1]) + w[-1], -40, 40)))
        r = (p - y) / len(y)
        g = np.append(x.back(r) + l2 * w[:-1], r.sum())
        if d.n:
            g[:-1] += swap * d.back(d.dot(w[:-1])) / d.n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, identity=IDENTITY, swap: float = SWAP) -> Model:
    """Learn from labelled rows; ``allowed`` (over ``labels``) says which."""
    sample = labelled_sample(docs, labels, allowed, max_rows)
    vocabulary, pos, neg = choose(sample, max_features, identity)
    if not vocabulary:
        return Model({}, float(np.log((pos + 0.5) / (neg + 1.0))))  # leans to clean
    rows = sample.mapInPandas(_rows(vocabulary, identity), "y int, x array<int>, d array<array<int>>").collect()
    k = len(vocabulary)
    x = _Sparse([np.asarray(r["x"], dtype=np.int64) for r in rows], None, k)
    moved = [np.asarray(d, dtype=np.int64) for r in rows for d in r["d"]]
    d = _Sparse([np.abs(c) - 1 for c in moved], [np.sign(c).astype(float) for c in moved], k)
    w, b = descend(x, np.asarray([r["y"] for r in rows], dtype=float), d, swap=swap)
    return Model({f: float(v) for f, v in zip(vocabulary, w, strict=True) if abs(v) > 1e-6}, b)


def scorer(model: Model):
    memo: dict[str, tuple] = {}  # most words carry no weight and share one empty entry

    def known(w: str) -> tuple:
        got = memo.get(w)
        if got is None:
            if len(memo) >= MEMO_WORDS:
                memo.clear()
            got = memo[w] = tuple((f, model.weights[f]) for f in word_features(w) if f in model.weights)
        return got

    @F.pandas_udf("double")
    def toxic_score(text: pd.Series) -> pd.Series:
        lean("toxicity")
        logits = []
        for t in text:
            hits = {}
            for w in set(WORDS(t.lower())):
                hits.update(known(w))
            logits.append(model.intercept + sum(hits[f] for f in sorted(hits)))
        return pd.Series(1 / (1 + np.exp(-np.clip(np.asarray(logits, dtype=float), -40, 40))))

    return toxic_score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``; same-named columns are replaced."""
    (s,) = fresh(docs, "score")
    base = docs.drop("score", "predicted")
    out = base.withColumn(s, scorer(model)(text_or_empty()))
    return out.withColumns({"score": F.col(s), "predicted": (F.col(s) >= 0.5).cast("int")}).drop(s)
