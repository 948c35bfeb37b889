"""Language identification by hierarchical discrimination.

A text is first given a language *family*, then a language inside it.  Both steps
are one-versus-one linear support vector machines: one for every pair of families,
and within a family one for every pair of its languages, which are the hard cases.
The winner of a step is the class with most duels, equal ones by their margins.

Features are the frequencies of hashed letter 1- to 4-grams of the lower-cased
text, words set apart by one blank, over the whole text however long.

Training.  At most ``PER_CLASS`` distinct texts a language, those of smallest hash,
are the sample (the only bound; it bounds the fit, not what is predicted).  Their
features are computed where the texts are; each pair is one group of at most twice
that many rows and is fitted in a task of its own by dual coordinate descent on its
kernel matrix.  A family's rows are those of its languages in equal shares.  The
model has ``64 KiB`` for every pair.

``FAMILIES`` lists usual codes; a language that it doesn't list is a family of its
own.  Only the primary subtag counts (``en-US`` is listed as ``en``).

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is
every text if there is nothing to learn from; with one language all others are it,
score 1.  Rows without a label, or whose text has no letter, teach nothing.
Repeated rows are predicted each.  Columns are not added to the caller's table: the
prediction is a struct column, so none clash.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import fresh, materialize

PER_CLASS = 800
BROADCAST_LANGUAGES = 1024  # up to which the sample's keys (PER_CLASS a language) are broadcast
GRAMS, BITS = 4, 14
SCALE, COST, ROUNDS = 30.0, 1.0, 40
PIECE = 1 << 20  # characters that are hashed at a time
UNKNOWN = "und"

# Language codes by family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ast ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "austronesian": "id jv mg ms su tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.split("-")[0].lower(), lang)


# ------------------------------------------------------------------ features


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-case code point of every letter, 0 of everything else."""
    table = np.zeros(0x110000, np.uint64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            table[i] = ord(c.lower()[0])
    return table


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed letter n-grams of a whole text."""
    table, out = _letters(), np.zeros(1 << BITS)
    tail, inside = np.zeros(1, np.uint64), False
    for at in range(0, len(text), PIECE):
        codes = table[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "replace"), np.uint32)]
        is_letter = codes > 0
        before = np.concatenate(([inside], is_letter[:-1]))
        codes = codes[is_letter | before]  # of what is no letter, only the first after a letter
        inside = bool(is_letter[-1])
        if at + PIECE >= len(text) and inside:
            codes = np.append(codes, np.uint64(0))
        seen = np.concatenate((tail, codes))
        rolled = seen
        for n in range(1, GRAMS + 1):
            if n > 1:
                rolled = (rolled[:-1] * np.uint64(1_000_003)) ^ seen[n - 1 :]
            new = rolled[max(0, len(tail) - n + 1) :]
            place = ((new + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
            out += np.bincount(place.astype(np.int64), minlength=1 << BITS)
        tail = seen[-(GRAMS - 1) :]
    return out


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def features(text: str) -> np.ndarray:
    counts = gram_counts(text)
    return (counts * (SCALE / max(counts.sum(), 1))).astype(np.float32)


def packed(x: np.ndarray) -> bytes:
    """The features that are not zero: places, then values."""
    at = np.nonzero(x)[0]
    return at.astype(np.uint16).tobytes() + x[at].tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), 1 << BITS), np.float32)
    for k, b in enumerate(rows):
        n = len(b) // 6
        out[k, np.frombuffer(b, np.uint16, n)] = np.frombuffer(b, np.float32, n, 2 * n)
    return out


# ------------------------------------------------------------------ machines


def fit_pair(x: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM (hinge loss) by dual coordinate descent."""
    kernel = (x @ x.T).astype(np.float64) + 1.0
    size = np.diag(kernel)
    alpha, value = np.zeros(len(sign)), np.zeros(len(sign))
    order = np.random.default_rng(0)
    for _ in range(ROUNDS):
        moved = 0.0
        for i in order.permutation(len(sign)):
            new = min(max(alpha[i] - (sign[i] * value[i] - 1) / size[i], 0.0), COST)
            step = new - alpha[i]
            if abs(step) > 1e-9:
                alpha[i] = new
                value += (step * sign[i]) * kernel[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return (x.T @ (alpha * sign)).astype(np.float32), float((alpha * sign).sum())


@dataclass(frozen=True)
class Step:
    """One decision among ``classes`` by duels of its pairs."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class number of each row and its share of the duels' confidence."""
        if not self.pairs:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margin = x @ self.weights.T + self.bias
        won, sure = np.zeros((len(x), len(self.classes))), np.zeros((len(x), len(self.classes)))
        for k, (i, j) in enumerate(self.pairs):
            p = 1 / (1 + np.exp(np.clip(-2 * margin[:, k], -60, 60)))
            won[:, i] += p >= 0.5
            won[:, j] += p < 0.5
            sure[:, i] += p
            sure[:, j] += 1 - p
        sure /= sure.sum(1, keepdims=True)
        best = np.argmax(won + 0.5 * sure, axis=1)
        return best, sure[np.arange(len(x)), best]


@dataclass(frozen=True)
class Model:
    root: Step | None
    inner: dict[str, Step]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if self.root is None:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        x = np.stack([features(t) for t in texts])
        which, score = self.root.decide(x)
        out = np.empty(len(texts), object)
        for f in np.unique(which):
            step, at = self.inner[self.root.classes[f]], np.nonzero(which == f)[0]
            lang, p = step.decide(x[at])
            out[at] = np.array(step.classes, object)[lang]
            score[at] = score[at] * p
        return out.tolist(), score


def _fitted(rows: pd.DataFrame) -> pd.DataFrame:
    node, first, second = rows["node"].iat[0], rows["a"].iat[0], rows["b"].iat[0]
    rows = rows.sort_values("h")
    x = unpacked(rows["x"].tolist())
    w, b = fit_pair(x, np.where(rows["own"] == first, 1.0, -1.0))
    return pd.DataFrame({"node": [node], "a": [first], "b": [second], "w": [w.tobytes()], "bias": [b]})


def sample(docs: DataFrame, lang: Column, allowed: Column, per_class: int = PER_CLASS) -> DataFrame:
    """``lang, h, nr, text``: at most ``per_class`` distinct texts of a language, by hash.

    A threshold on the hash, from the language's count of distinct texts, leaves
    about a quarter more than wanted before rows of a language meet to be ranked."""
    from pyspark.sql import Window

    usable = docs.filter(allowed & lang.isNotNull() & has_letter(F.col("text"))).select(
        lang.cast("string").alias("lang"), F.col("text"), F.xxhash64("text").alias("h")
    )
    known = materialize(usable.select("lang", "h").distinct(), "language-texts")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language
    small = F.broadcast if len(counts) <= BROADCAST_LANGUAGES else lambda df: df
    # the 32 high bits of the hash are uniform in this range
    room = [(r["lang"], int(min(1.0, 1.25 * per_class / r["n"] + 64 / r["n"]) * 2**32) - 2**31) for r in counts]
    shares = docs.sparkSession.createDataFrame(room, "lang string, below bigint")
    drawn = known.join(small(shares), "lang").filter(F.shiftright("h", 32) < F.col("below"))
    ranked = drawn.select("lang", "h", F.row_number().over(Window.partitionBy("lang").orderBy("h")).alias("nr"))
    chosen = ranked.filter(F.col("nr") <= per_class)
    # copies of a text are combined before they are shuffled
    return usable.join(small(chosen), ["lang", "h"]).groupBy("lang", "h", "nr").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, lang: Column, allowed: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """Learns from the rows of ``docs`` (column ``text``) where ``allowed``."""
    rows = materialize(sample(docs, lang, F.lit(True) if allowed is None else allowed, per_class), "language-sample")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not langs:
        return Model(None, {})
    members: dict[str, list[str]] = defaultdict(list)
    for name in langs:
        members[family(name)].append(name)
    families = sorted(members)

    @F.pandas_udf("binary")
    def encoded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: packed(features(t)))

    duels = [("", a, b) for a, b in combinations(families, 2)]
    duels += [(f, a, b) for f in families for a, b in combinations(members[f], 2)]
    models: dict[tuple[str, str, str], tuple[np.ndarray, float]] = {}
    if duels:
        seats = [(n, a, b, x) for n, a, b in duels for x in (a, b)]
        in_duel = docs.sparkSession.createDataFrame(seats, "node string, a string, b string, own string")
        kinship = [(name, family(name), -(-per_class // len(members[family(name)]))) for name in langs]
        kin = docs.sparkSession.createDataFrame(kinship, "lang string, family string, share int")
        ready = materialize(rows.select("lang", "h", "nr", encoded("text").alias("x")).join(kin, "lang"), "language-features")
        by_family = ready.filter("nr <= share").select(F.lit("").alias("node"), F.col("family").alias("own"), "h", "x")
        by_lang = ready.select(F.col("family").alias("node"), F.col("lang").alias("own"), "h", "x")
        seated = by_family.union(by_lang).join(in_duel, ["node", "own"])
        fitted = seated.groupBy("node", "a", "b").applyInPandas(_fitted, "node string, a string, b string, w binary, bias double")
        models = {(r["node"], r["a"], r["b"]): (np.frombuffer(r["w"], np.float32), r["bias"]) for r in fitted.collect()}

    def step(node: str, classes: list[str]) -> Step:
        own = list(combinations(classes, 2))
        place = {c: k for k, c in enumerate(classes)}
        return Step(
            classes, [(place[a], place[b]) for a, b in own],
            np.stack([models[node, a, b][0] for a, b in own]) if own else np.zeros((0, 1 << BITS), np.float32),
            np.array([models[node, a, b][1] for a, b in own]),
        )

    return Model(step("", families), {f: step(f, members[f]) for f in families})


def predictor(model: Model):
    """A function of a text column that gives ``struct<lang, score>``."""

    @F.pandas_udf("lang string, score double")
    def known(texts: pd.Series) -> pd.DataFrame:
        lang, score = model.predict(texts.tolist())
        return pd.DataFrame({"lang": lang, "score": score})

    nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    return lambda text: F.when(has_letter(text), known(F.coalesce(text, F.lit("")))).otherwise(nothing)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a struct column of the prediction; its name is the last column's."""
    return docs.withColumn(fresh(docs, "language")[0], predictor(model)(F.col(text).cast("string")))
