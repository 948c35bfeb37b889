import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import hard_negatives as hn
from sitelens.llm.q_negatives import op12
from tests.llm.helpers import written

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, block string, cell int"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def vectors(n=700, dim=20, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    out = []
    for i in range(n):
        k = int(rng.integers(4))
        v = 0.6 * centres[k] + rng.normal(size=dim)
        v /= np.linalg.norm(v)
        label = [0, 1, 1, 7][k] if i % 11 else int(rng.integers(10))
        if 300 <= i < 420:
            v, label = np.asarray(out[0][1]), i % 3  # copies: ties in every score
        out.append((i, [float(x) for x in v.astype(np.float32)], label, "s", "b", 1))
    bad = [
        (None, [1.0], 1, "s", "b", 1), (1000, None, 1, "s", "b", 1), (1001, [1.0, None], 1, "s", "b", 1), (1002, [float("nan")], 1, "s", "b", 1),
        (1003, [float("inf")], 1, "s", "b", 1), (1004, [0.5], None, "s", "b", 1), (1100, [], 2, "s", "b", 1), (1200, [3.0, -2.0], 8, "s", "b", 1),
        (1300, [1e30], 1, "s", "b", 1), (-100, [0.25] * 20, 3, "s", "b", 1),
    ]
    return out + bad + out[:3]  # repeated rows


def brute(rows, moved=True):
    take = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not abs(x) < 30000 for x in v):
            continue
        label = math.fmod(label + 1, 10) if moved and i % 7 == 0 else label
        take[i] = (int(label), [math.floor(256 * x) for x in v])
    out = []
    for a in take:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(take[a][1], v)), i) for i, (_, v) in take.items() if i != a)
        same = [(s, i) for s, i in scored if take[i][0] == take[a][0]][:5]
        for ps, p in same:
            fit = [(s, i) for s, i in scored if take[i][0] != take[a][0] and 30 * -ps <= 100 * -s <= 90 * -ps][:10]
            out += [(a, p, r, i, -ps, -s) for r, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def collect(df):
    return sorted(tuple(r) for r in df.select(NAMES).collect())


@pytest.mark.parametrize("rows,step,anchors", [(64, 16, 3), (4096, 512, 1024)])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, rows, step, anchors):
    for name, v in (("BLOCK_ROWS", rows), ("STEP_ROWS", step), ("ANCHOR_ROWS", anchors)):
        monkeypatch.setattr(hn, name, v)
    sf = written(spark, tmp_path, embeddings=spark.createDataFrame(vectors(), SCHEMA))
    want = brute(vectors())
    assert len(want) > 200 and collect(op12(spark, sf)) == want


def test_intervals_hold_and_narrow():
    rng = np.random.default_rng(2)
    for width, size in ((64, 256), (128, 1 << 22)):
        x = rng.integers(-size, size, (300, width))
        x[0], x[1] = 0, x[2]
        q = rng.integers(-size, size, (20, width))
        low, high = hn.Queries(q).intervals(slice(0, 20), *hn.encode(x))
        true = q @ x.T
        assert (low <= true).all() and (true <= high).all()
        reach = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
        assert np.median((high - low)[:, 3:] / reach[:, 3:]) < 0.4


def test_intervals_drop_most_rows():
    rows = [r for r in vectors(4000, 64) if r[1] and len(r[1]) == 64]
    x = np.floor(256 * np.array([r[1] for r in rows], np.float64)).astype(np.int64)
    low, high = hn.Queries(x[:50]).intervals(slice(0, 50), *hn.encode(x))
    fifth = np.sort(x[:50] @ x.T, axis=1)[:, -6]
    assert (high >= fifth[:, None]).mean() < 0.2


def test_best_keeps_ties_by_id():
    best = hn.Best(2, 3)
    best.add(np.array([0, 0, 1, 0]), np.array([5, 7, -1, 5]), np.array([9, 4, 2, 3]))
    best.add(np.array([0, 1]), np.array([5, hn.NONE + 1]), np.array([1, 8]))
    assert list(best.rows()) == [(0, 4, 7), (0, 1, 5), (0, 3, 5), (1, 2, -1), (1, 8, hn.NONE + 1)]


def test_empty_and_single(spark, tmp_path):
    df = spark.createDataFrame(vectors(), SCHEMA)
    assert op12(spark, written(spark, tmp_path / "a", embeddings=df.limit(0))).count() == 0
    assert op12(spark, written(spark, tmp_path / "b", embeddings=df.filter("vec_id = 200"))).count() == 0
    two = hn.hard_negatives(hn.integer_vectors(df.filter("vec_id < 50")), F.col("vec_id") == 5, positives=1, negatives=2)
    assert {r["rank"] for r in two.collect()} <= {1, 2}
