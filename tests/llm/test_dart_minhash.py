import random
import re
from collections import Counter
from math import comb

import numpy as np

from sitelens.llm import dart_minhash as dm
from sitelens.llm.shingles import counted, shingles
from tests.llm.helpers import awkward, frame, sentence


def bag(text):
    ws = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    return Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else Counter()


def alike(a, b):
    x, y = bag(a), bag(b)
    return 1.0 if not x and not y else sum((x & y).values()) / sum((x | y).values())


def classes(rows, threshold=0.8):
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(rows[i][1], rows[j][1]) >= threshold:
                up[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    return {frozenset(repr((rows[i][0], rows[i][1])) for i in g) for g in groups.values()}


def test_shingles_like_python():
    rows = [t for _, t, *_ in awkward()]
    text, h, times = counted(*shingles(rows))
    for i, t in enumerate(rows):
        assert sorted(times[text == i]) == sorted(bag(t).values())
    a = dict(zip(h[text == 5], times[text == 5], strict=True))
    assert a == dict(zip(h[text == 6], times[text == 6], strict=True))


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    h = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    wa, wb = rng.uniform(0.1, 4, 400), rng.uniform(0.1, 4, 400)
    sig = dm.signatures(2, np.repeat([0, 1], 400), np.concatenate([h, h]), np.concatenate([wa, wb]), 2000)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_groups_match_brute_force(spark):
    rng = random.Random(9)
    rows = awkward()
    base = sentence(rng, 120).split(" ")
    for i in range(30):  # copies of one original, each with its own edits
        w = list(base)
        for _ in range(2):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(10**6)
        rows.append((100 + i, " ".join(w), "en", "s", 1, "n", "d", "b", 1, "s"))
    rows.append((99, " ".join(base), "en", "s", 1, "n", "d", "b", 1, "s"))
    got = {}
    docs = frame(spark, rows)
    for r in dm.near_groups(docs).join(docs.selectExpr("doc_id id", "text t", "unhex(md5(cast(coalesce(text, '') as binary))) n").distinct(), "1=1" and dm.F.expr("node = n and doc_id <=> id")).collect():
        got.setdefault(r["class_id"], []).append(repr((r["doc_id"], r["t"])))
    have = {frozenset(g) for g in got.values()}
    want = classes(rows)
    # groups that share their smallest id show under one class id
    assert {x for g in have for x in g} == {x for g in want for x in g}
    for g in want:
        assert any(g <= h for h in have)


def test_one_of_each_group_stays(spark):
    rows = [r for r in awkward() if r[0] not in (None, 14)]
    out = dm.drop_near_copies(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    assert {r["doc_id"] for r in out.collect()} == {min(int(re.match(r"\((\d+),", x)[1]) for x in g) for g in classes(rows)}
    assert dm.drop_near_copies(frame(spark, [])).count() == 0


def test_null_and_repeated_ids_keep_every_group(spark):
    rng = random.Random(8)
    rows = awkward() + [(i, sentence(rng, 40), "en", "s", 1, "n", "d", "b", 1, "s") for i in (None, None, 14, 50)]
    docs = frame(spark, rows)
    want = classes(rows)
    kept = Counter(repr((r["doc_id"], r["text"])) for r in dm.drop_near_copies(docs).collect())
    assert sum(kept.values()) == len(want)
    for g in want:
        assert sum(kept[x] for x in g) == 1
    groups = {}
    texts = docs.selectExpr("doc_id", "coalesce(text, '') text", "unhex(md5(cast(coalesce(text, '') as binary))) node").distinct()
    for r in dm.near_groups(docs).join(texts.withColumnRenamed("doc_id", "id"), "node").filter("doc_id <=> id").collect():
        groups.setdefault(bytes(r["root"]), []).append(r)
    assert len(groups) == len(want)
    for g in groups.values():
        assert len({(r["doc_id"], r["node"]) for r in g if r["kept"]}) == 1


def test_signatures_hardly_lose_pairs_at_the_threshold():
    least = int((dm.THRESHOLD - dm.SLACK) * dm.COORDINATES)
    free = dm.COORDINATES - dm.ROWS  # a shared band agrees anyway
    lost = sum(comb(free, i) * dm.THRESHOLD**i * (1 - dm.THRESHOLD) ** (free - i) for i in range(least - dm.ROWS))
    assert lost < 1e-6


def test_repeated_rows_leave_one(spark):
    rows = [(5, "a b c d e f g", "en", "s", 1, "n", "d", "b", 1, "s")] * 3
    assert dm.drop_near_copies(frame(spark, rows)).count() == 1


def test_components_in_steps_equal_components_at_once(spark):
    rng = random.Random(4)
    pairs = [(bytes([rng.randrange(60)]), bytes([rng.randrange(60)])) for _ in range(45)] + [(bytes([70 + i]), bytes([71 + i])) for i in range(12)]
    df = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "a binary, b binary")
    whole = {bytes(r["node"]): bytes(r["root"]) for r in dm.components(df).collect()}
    rows = df.collect()
    first = spark.createDataFrame(rows[::2], df.schema)
    second = spark.createDataFrame(rows[1::2], df.schema)
    steps = {bytes(r["node"]): bytes(r["root"]) for r in dm.components(second, dm.components(first)).collect()}
    assert steps == whole


def loosely_alike(n):
    """Texts of one original with so many edits each that two are about 0.66 alike."""
    rng = random.Random(21)
    base = sentence(rng, 150).split(" ")
    rows = []
    for i in range(n):
        w = list(base)
        for place in rng.sample(range(5, 145, 5), 3):
            w[place] = "own%dx%d" % (i, place)
        rows.append((i, " ".join(w), "en", "s", 1, "n", "d", "b", 1, "s"))
    return rows


def test_pairs_below_the_threshold_do_not_fetch_their_texts(spark, monkeypatch):
    rows = loosely_alike(40)
    rows += [(100 + i, r[1] + " end%d" % i, *r[2:]) for i, r in enumerate(rows[:5])]
    fetched, plain = [], dm.verified
    monkeypatch.setattr(dm, "verified", lambda pairs, *a: (fetched.append(pairs.count()), plain(pairs, *a))[1])
    got = {}
    for r in dm.near_groups(frame(spark, rows)).collect():
        got.setdefault(r["class_id"], set()).add(repr((r["doc_id"], rows[r["doc_id"] % 100 + 40 * (r["doc_id"] >= 100)][1])))
    assert {frozenset(g) for g in got.values()} == classes(rows) and len(got) > 30
    assert fetched[-1] < 3 * len(rows)  # 45 * 44 / 2 pairs are alike, but not enough


def test_cells_bound_the_similarity_from_above(spark):
    rows = [r[1] or "" for r in awkward()] + [r[1] for r in loosely_alike(6)] + ["again and " * 70000, "again and " * 70001]
    texts = spark.createDataFrame([(bytes([i]), t) for i, t in enumerate(rows)], "node binary, text string")
    cells = dm.in_cells(texts)
    assert [bytes(r["node"])[0] for r in cells.filter("cells is null").collect()] == [len(rows) - 2, len(rows) - 1]
    one, two = (cells.select(*[dm.F.col(c).alias(f"{c}_{x}") for c in ("mass", "cells")], dm.F.col("node").alias(x)) for x in "ab")
    for threshold in (0.5, 0.8, 1.0):
        passed = {(bytes(r["a"])[0], bytes(r["b"])[0]) for r in one.crossJoin(two).filter(dm._may_reach(threshold)).select("a", "b").collect()}
        assert {(i, j) for i, x in enumerate(rows) for j, y in enumerate(rows) if alike(x, y) >= threshold} <= passed
