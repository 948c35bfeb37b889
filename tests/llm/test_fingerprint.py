import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from sitelens.llm import fingerprint as fp
from sitelens.llm.q_fingerprint import op6
from tests.llm.helpers import awkward, frame, written


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def sketch(text):
    ws = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    hs = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in ws]
    out = set()
    for i in range(max(1, len(hs) - 4) if hs else 0):
        h = 42
        for x in hs[i : i + 5]:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), h)
        out.add(signed(h))
    low = sorted(h for h in out if h < fp.THRESHOLD)
    return low or sorted(out)[:1]


def test_sketch_matches_brute_force(spark):
    got = fp.with_sketch(frame(spark), "text", "s").select("text", "s").collect()
    assert len(got) == len(awkward())
    for r in got:
        assert list(r["s"]) == sketch(r["text"])


def test_merge_and_containment(spark):
    a, b = awkward()[9][1], awkward()[10][1]
    df = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, c string")
    for c in "abc":
        df = fp.with_sketch(df, c, f"s_{c}")
    r = df.select(
        fp.containment(F.col("s_a"), F.col("s_c")).alias("in"), fp.merge(F.col("s_a"), F.col("s_b")).alias("m"), "s_c",
        fp.likeness(F.col("s_a"), F.array().cast("array<bigint>")).alias("none"),
    ).first()
    assert r["in"] == 1.0 and set(r["m"]) <= set(r["s_c"]) and r["none"] == 0.0


def test_query_against_brute_force(spark, tmp_path):
    rows = [r for r in awkward() if r[0] is not None and r[0] != 14]
    out = {r["doc_id"]: r for r in op6(spark, written(spark, tmp_path, documents=frame(spark, rows))).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(out) == len(rows)
    for i, r in enumerate(order):
        text, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        got = out[r[0]]
        assert got["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got["n_chars"] == len(text)
        assert got["edited_fingerprint"] == ",".join(f"{h % (1 << 64):016x}" for h in sketch(edited))
        a, b = set(sketch(text)), set(sketch(nxt))
        want = float(len(a) == len(b)) if not a or not b else len(a & b) / min(len(a), len(b))
        assert abs(got["near_next"] - want) < 1e-12


def test_next_across_runs_repeated_and_null_ids(spark, tmp_path, monkeypatch):
    from sitelens.llm import q_fingerprint as q

    monkeypatch.setattr(q, "RUN_ROWS", 3)
    assert op6(spark, written(spark, tmp_path, documents=frame(spark))).count() == len(awkward())
    rows = [(i, f"text number {i} of many", "en", "s", 1, "n", "d", "b", 1, "s") for i in range(40)]
    got = {r["doc_id"]: r["edited_sha256"] for r in op6(spark, written(spark, tmp_path, documents=frame(spark, rows))).collect()}
    for i in range(40):
        t, n = rows[i][1], rows[(i - 1) % 40][1]
        assert got[i] == hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()
    assert op6(spark, written(spark, tmp_path, documents=frame(spark, []))).count() == 0
