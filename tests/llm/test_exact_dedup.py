import re
from collections import defaultdict

import numpy as np

from sitelens.llm import exact_dedup as ed
from tests.llm.helpers import COLS, awkward, frame


def key(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def winners(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[key(r[1])].append(r)
    return {k: min(v, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for k, v in groups.items()}, groups


def test_groups_match_brute_force(spark):
    rows = awkward()
    best, groups = winners(rows)
    got = ed.exact_groups(frame(spark)).collect()
    assert len(got) == len(rows)
    by_text = {bytes(r["digest"]): r for r in got}
    assert len(by_text) == len(groups)
    for r in got:
        assert any(r["keep_id"] == best[k][0] and r["group_size"] == len(groups[k]) for k in groups)


def test_one_row_of_each_group_stays(spark):
    rows = awkward()
    best, groups = winners(rows)
    out = ed.drop_repeats(frame(spark))
    assert out.columns == frame(spark).columns
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(kept) == len(groups)
    assert {key(t) for _, t in kept} == set(groups)
    assert sorted(map(repr, kept)) == sorted(repr((b[0], b[1])) for b in best.values())


def test_history_removes_repeats_and_groups_the_rest(spark):
    old = frame(spark, awkward()[:9])
    new = frame(spark, [(100 + (r[0] or 0), *r[1:]) for r in awkward()])
    got = ed.exact_groups(new, history=old).collect()
    assert len(got) == len(awkward())
    seen = {key(r[1]) for r in awkward()[:9]}
    kept = [r for r in got if r["kept"]]
    fresh = {key(r[1]) for r in awkward()} - seen
    assert len({bytes(r["digest"]) for r in kept}) == len(fresh)
    assert all(r["keep_id"] is None or r["keep_id"] < 100 for r in got if not r["kept"] and r["keep_id"] not in {k["doc_id"] for k in kept})


def test_placement_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 1000, 20000):
        h0, h1, h2 = rng.integers(0, 1 << 31, n), rng.integers(0, 1 << 31, n), rng.integers(1, 1 << 20, n)
        buckets = max(1, n // ed.BUCKET_KEYS)
        seeds, slots = ed.place(h0, h1, h2, buckets)
        assert sorted(slots) == list(range(n))
        seed = seeds[h0 % buckets]
        again = np.where(seed < 0, -seed - 1, ed._slot_np(h1, h2, seed, n))
        assert (again == slots).all()


def test_empty(spark):
    none = spark.createDataFrame([], COLS)
    assert ed.exact_groups(none).count() == 0 and ed.drop_repeats(none).count() == 0
    assert ed.exact_groups(frame(spark), history=none).count() == len(awkward())
