import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np

from sitelens.llm import hmm
from sitelens.llm.q_lm import op10
from tests.llm.helpers import awkward, frame, written


def test_forward_is_exact_and_em_raises_the_likelihood():
    rng = np.random.default_rng(0)
    model = hmm.Hmm.initial(rng.random(4) * 10, 2)
    texts = [np.array([0, 1, 3]), np.array([2]), np.array([1, 1, 2, 0]), np.array([3, 0])]
    for t, got in zip(texts, hmm.log10_likelihood(texts, model), strict=True):
        p = 0.0
        for path in itertools.product(range(2), repeat=len(t)):
            q = model.start[path[0]] * model.emit[path[0], t[0]]
            for i in range(1, len(t)):
                q *= model.move[path[i - 1], path[i]] * model.emit[path[i], t[i]]
            p += q
        assert math.isclose(got, math.log10(p), rel_tol=1e-9)
    long = [rng.integers(0, 4, n) for n in (50, 400, 3)] + [np.zeros(300, int)]
    m = hmm.Hmm.initial(np.bincount(np.concatenate(long), minlength=4), 2)
    last = -1e9
    for _ in range(5):
        now = hmm.log10_likelihood(long, m).sum()
        assert now > last
        v = hmm.expected_counts(long, m)
        assert math.isclose(v[6:].sum(), sum(map(len, long)), rel_tol=1e-9)
        m, last = hmm.Hmm.from_counts(v, 2, np.zeros(4)), now


def tokens(text):
    raw = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", raw) if w]


def test_counts_and_base_score_on_awkward_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hmm, "CHUNK_TOKENS", 500)
    rows = awkward() + [(i, f"Word word{i % 7} the THE the", "en", "s", 1, "n", "d", "b", 1, "s") for i in range(100, 180)]
    got = op10(spark, written(spark, tmp_path, documents=frame(spark, rows))).collect()
    assert len(got) == len(rows)

    def held(i):
        return zlib.crc32(str("" if i is None else i).encode()) % 10 == 0

    c, ends = Counter(), 0
    for r in rows:
        if not held(r[0]):
            c.update(tokens(r[1]))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    want = []
    for r in rows:
        ws = tokens(r[1])
        s = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) + math.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        want.append((repr(r[0]), held(r[0]), len(ws) + 1, sum(w in c for w in ws) + 1, n, round(s, 6)))
    have = [(repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got]
    assert sorted(have) == sorted(want)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_empty_table(spark, tmp_path):
    assert op10(spark, written(spark, tmp_path, documents=frame(spark, []))).count() == 0


def test_beats_the_base_on_held_out_rows(spark):
    r = op10(spark, "/root/testdata/sf0.001").filter("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r["s"] > r["b"]
