import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import language_id as li
from sitelens.llm.q_lang import op13
from tests.llm.helpers import awkward, frame, written

SF = "/root/testdata/sf0.01"


def plain_counts(text):
    """The same features, letter by letter."""
    seq, inside = [0], False
    for c in text:
        if c.isalpha():
            seq.append(ord(c.lower()[0]))
        elif inside:
            seq.append(0)
        inside = c.isalpha()
    if inside:
        seq.append(0)
    out, m = np.zeros(1 << li.BITS), 1 << 64
    for n in range(1, li.GRAMS + 1):
        # the blank before the text is no 1-gram of it
        for at in range(1 if n == 1 else 0, len(seq) - n + 1):
            h = seq[at]
            for c in seq[at + 1 : at + n]:
                h = (h * 1_000_003 % m) ^ c
            out[((h + n) * 0x9E3779B97F4A7C15 % m) >> (64 - li.BITS)] += 1
    return out


@pytest.mark.parametrize("text", ["", "a", " a", "12 ", "Été  déjà, vu!", "x" * 30 + " . " + "ÜbEr 1a2b", *[t for _, t, *_ in awkward() if t][:8]])
@pytest.mark.parametrize("piece", [1, 3, 7, 1 << 20])
def test_features_of_whole_texts(monkeypatch, text, piece):
    monkeypatch.setattr(li, "PIECE", piece)
    assert np.array_equal(li.gram_counts(text), plain_counts(text))


def test_packed_features_come_back():
    x = np.stack([li.features(t) for t in ("", "eins zwei", "a" * 99)])
    assert np.array_equal(li.unpacked([li.packed(v) for v in x]), x)


def test_pair_is_the_svm_optimum():
    """Dual descent against plain subgradient steps on the primal objective."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)).astype(np.float32)
    y = np.sign(x[:, 0] + 0.4 * rng.normal(size=60))
    w, b = li.fit_pair(x, y)

    def objective(w, b):
        return 0.5 * (w @ w + b * b) + li.COST * np.maximum(0, 1 - y * (x @ w + b)).sum()

    best, v, c = np.inf, np.zeros(5), 0.0
    for t in range(1, 20000):
        on = y * (x @ v + c) < 1
        v, c = v - (v - (y[on, None] * x[on]).sum(0)) * (0.5 / t), c - (c - y[on].sum()) * (0.5 / t)
        best = min(best, objective(v, c))
    assert objective(w, b) <= best * 1.01


def test_duels_and_families():
    step = li.Step(["a", "b", "c"], [(0, 1), (0, 2), (1, 2)], np.eye(3, dtype=np.float32), np.zeros(3))
    best, p = step.decide(np.array([[1.0, 2, 5], [-1, -2, 3], [-1, -1, -1]]))
    assert best.tolist() == [0, 1, 2] and ((p > 0.33) & (p <= 1)).all()
    assert li.family("en-US") == li.family("de") == "germanic" and li.family("tlh") == "tlh"


def test_held_out_accuracy_and_nothing_else_read(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in op13(spark, SF).collect()}
    true = {r["doc_id"]: r for r in docs.collect()}
    assert got.keys() == true.keys()
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in set(held)) for i in got)
    assert sum(got[i]["lang_pred"] == true[i]["lang"] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # labels of held-out rows, sources and lengths change nothing
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit("xx")).otherwise(F.col("lang")))
    other = other.withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(0))
    again = {r["doc_id"]: r for r in op13(spark, written(spark, tmp_path, documents=other)).collect()}
    assert again == got


def test_awkward_rows(spark, tmp_path):
    rows = [(i, t, lang, *rest) for k, (i, t, _, *rest) in enumerate(awkward()) for lang in [["en", "fr", None, "tlh"][k % 4]]]
    docs = frame(spark, rows)
    out = op13(spark, written(spark, tmp_path, documents=docs)).collect()
    assert len(out) == len(rows)
    by_text = {(i, t): None for i, t, *_ in rows}
    langs = {"en", "fr", "tlh"}
    for r, (_, t, *_) in zip(sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"])), sorted(rows, key=lambda r: (r[0] is None, r[0])), strict=True):
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 4 == 2)
        assert r["lang_pred"] in langs | {"und"}
    assert by_text and {r["doc_id"] for r in out if r["lang_pred"] == "und"} >= {1, 2, 3}


def test_one_language_none_and_empty(spark, tmp_path):
    docs = frame(spark)
    one = op13(spark, written(spark, tmp_path / "one", documents=docs)).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("en", 1.0), ("und", 0.0)}
    none = op13(spark, written(spark, tmp_path / "none", documents=docs.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert op13(spark, written(spark, tmp_path / "empty", documents=docs.limit(0))).count() == 0


def test_sample_is_bounded_and_distinct(spark):
    rows = [(i, f"word {'abcdefgh'[i % 8]}{'xyz'[i % 3]}", "en" if i % 2 else "de", "s", 1, "n", "d", "b", 1, "s") for i in range(500)]
    got = li.sample(frame(spark, rows), F.col("lang"), F.lit(True), per_class=7).collect()
    assert len(got) == 14 and len({(r["lang"], r["text"]) for r in got}) == 14
    assert "__language" in li.identify(frame(spark, rows[:3]), li.Model(None, {})).columns
