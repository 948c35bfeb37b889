import hashlib
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from sitelens.llm import prefix_trie as pt
from sitelens.llm.q_trie import op11
from tests.llm.helpers import written

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, words int, shard string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows():
    out = []

    def add(c, *texts):
        out.extend((c, i, "user" if i % 2 == 0 else "assistant", t, "p", 1, "s") for i, t in enumerate(texts))

    for c in range(0, 140):
        if c % 20 == 0 and c != 60:  # conversations 61 to 79 have no base
            add(c, f"open {c // 40}", "and then", "so be it", *[f"more {c}"] * (c % 7))
        elif c % 3 == 0:
            add(c, "hello there", "general", "a bold one", "indeed")
        else:
            add(c, *[f"word {k} of {c % 5}" for k in range(c % 4 + 1)])
    add(500, *["again and again"] * 300)  # long, few bases
    out += [(None, 0, "user", "lost", "p", 1, "s"), (7, None, None, None, "p", 1, "s"), (7, 0, "user", "", "p", 1, "s")]
    out += [(8, 0, "user", "twice", "p", 1, "s")] * 2 + [(-3, 1, "user", "é　b\tc", "p", 1, "s"), (9, 3, "a", "b", "p", 1, "s"), (9, 3, "ab", "", "p", 1, "s")]
    return out


def key(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, key(role, text), role, text))
    convs = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    again = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        again[c] = convs.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in again.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    found = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        leaves = sum(found[k][0] for k in kids[p]) or 1
        found[p] = leaves, sum(found[k][1] for k in kids[p]) + (len(members[p]) - 1) * words
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *found[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(again[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


def collect(df):
    return sorted(tuple(r) for r in df.select(NAMES).collect())


def test_query_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK_IDS", 4)  # copies of a path fill several blocks
    sf = written(spark, tmp_path, conversations=spark.createDataFrame(rows(), SCHEMA))
    want = brute(rows())
    assert collect(op11(spark, sf)) == want
    assert any(n == 0 for _, n, *_ in want) and max(r[1] for r in want) == 300


def test_any_number_of_shards_gives_the_same_nodes(spark, monkeypatch):
    paths = pt.conversation_paths(spark.createDataFrame(rows(), SCHEMA))
    whole = collect(pt.prefix_trie(paths, shards=1))
    monkeypatch.setattr(pt, "BROADCAST_NODES", 3)  # skeleton joined by shuffle
    assert collect(pt.prefix_trie(paths, shards=40)) == whole


def test_skeleton_shares_and_local_nodes():
    paths = sorted({tuple("abc"[i % 3] + str(j) for j in range(i % 5)) + (f"x{i}",) for i in range(60)})
    splitters = pt.splitters_of([list(p) for p in paths], 8)
    assert splitters == sorted(splitters) and 5 <= len(splitters) <= 7
    skeleton = pt.skeleton_of(splitters)
    shard = [sum(list(p) >= s for s in splitters) for p in paths]
    out = [r for r in pt.walk(((s, list(p), [1] * len(p), i, 1, "e") for i, (s, p) in enumerate(zip(shard, paths, strict=True))), skeleton)]
    whole = [r for r in out if r[-1] is None]
    assert len({(r[0], r[1]) for r in whole}) == len(whole)  # no node outside the skeleton is met twice
    assert len([r for r in out if r[-1] == 0]) == len(set(shard))  # every shard leaves its part of the root


def test_equal_first_turns_and_texts_read_back(spark):
    conv = spark.createDataFrame(rows(), SCHEMA)
    nodes = pt.with_turns(pt.prefix_trie(pt.conversation_paths(conv)), conv)
    assert nodes.filter("depth > 0 AND text IS NULL").count() == 0
    assert nodes.filter("depth = 0").select("text").collect() == [(None,)]
    bad = nodes.filter(pt.turn_key(F.col("role"), F.col("text")) != F.col("turn_key"))
    assert bad.count() == 0


def test_turnless_and_empty(spark, tmp_path):
    # 61 has one turn, no base, and loses its first turn when h > 0
    c = next(c for c in range(61, 80) if zlib.crc32(str(c).encode()) % 4 > 0)
    one = spark.createDataFrame([(c, 0, "user", "x", "p", 1, "s")], SCHEMA)
    sf = written(spark, tmp_path, conversations=one)
    assert collect(op11(spark, sf)) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    empty = written(spark, tmp_path / "none", conversations=one.limit(0))
    assert op11(spark, empty).count() == 0
