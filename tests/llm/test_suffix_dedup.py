import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitelens.llm import suffix_dedup as sd
from sitelens.llm.q_suffix import op8
from sitelens.llm.suffix_array import suffix_order
from tests.llm.helpers import awkward, frame, sentence, written


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.integers(1, 70))
def test_suffix_order(s, depth):
    order = suffix_order(np.array(s, dtype=np.int64), depth).tolist()
    assert sorted(order) == list(range(len(s)))
    assert [s[i : i + depth] for i in order] == sorted(s[i : i + depth] for i in range(len(s)))
    assert suffix_order(np.array(s, dtype=np.int64), 10**6).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows):
    seen, out = set(), {}
    for r in sorted(rows, key=lambda r: r[0]):
        raw = (r[1] or "").encode()
        cover = np.zeros(len(raw) + 1, dtype=int)
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                cover[i] += 1
                cover[i + 100] -= 1
            seen.add(w)
        gone = np.cumsum(cover[:-1]) > 0
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[r[0]] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def passages(seed=4):
    rng = random.Random(seed)
    shared = [sentence(rng, 50) for _ in range(4)]
    rows = [r for r in awkward() if r[0] not in (None, 14)]
    for i in range(60):
        t = " ".join(rng.choice([sentence(rng, rng.randint(0, 12)), rng.choice(shared)[rng.randint(0, 40) :]]) for _ in range(6))
        rows.append((200 + i, t, "en", "s", 1, "n", "d", "b", 1, "s"))
    return rows


@pytest.mark.parametrize("hot,bucket", [(sd.HOT_RUNS, sd.BUCKET_BYTES), (3, 2000)])
def test_against_brute_force(spark, tmp_path, monkeypatch, hot, bucket):
    monkeypatch.setattr(sd, "HOT_RUNS", hot)
    monkeypatch.setattr(sd, "BUCKET_BYTES", bucket)
    rows = passages()
    docs = frame(spark, rows).repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op8(spark, written(spark, tmp_path, documents=docs)).collect()}
    assert got == brute(rows)
    assert sum(v[1] for v in got.values()) > 3000


def test_a_chunk_sends_a_hot_window_once():
    rng = random.Random(6)
    quote = sentence(rng, 40)[:130]
    texts = [sentence(rng, 15) + quote + sentence(rng, 15) for _ in range(50)]
    numbers = rng.sample(range(50), 50)
    rows = pa.record_batch({"doc_id": pa.array(numbers, pa.int64()), "text": pa.array(texts)})
    data, at = sd._bytes_of(pa.Table.from_batches([rows]), "text")
    hot = np.unique(sd.runs_of(data, at)[2] | np.uint64(1))
    left, right = pa.table({"chunk": [7], "rows": [sd._pack([rows])]}), pa.table({"anchors": [hot.tobytes()]})
    sent, known = {}, set()
    for b in sd._emit_runs("text", "doc_id", 3)(left, right).to_pylist():
        row, start, size = np.frombuffer(b["rows"], np.int32), np.frombuffer(b["starts"], np.int64), np.frombuffer(b["sizes"], np.int64)
        if b["texts"] is None:
            known |= {(r, i) for r, x, y in zip(row.tolist(), start.tolist(), size.tolist(), strict=True) for i in range(x, y + 1)}
            continue
        raw = pa.decompress(b["texts"], decompressed_size=b["n_bytes"], codec="zstd", asbytes=True)
        for j, (r, x) in enumerate(zip(row.tolist(), start.tolist(), strict=True)):
            assert sent.setdefault(raw[100 * j : 100 * j + 100], (r, x)) == (r, x)
    want, places = {}, set()
    for r in sorted(range(50), key=numbers.__getitem__):
        t = texts[r].encode()
        for i in range(len(t) - 99):
            want.setdefault(t[i : i + 100], (r, i))
            places.add((r, i))
    assert sent == want
    assert known == places - set(want.values()) and len(known) > 49 * 30


def test_runs_across_blocks(monkeypatch):
    rng = random.Random(1)
    data = np.frombuffer(sentence(rng, 4000).encode(), dtype=np.uint8)
    whole = sd.runs_of(data, np.array([0, 5000, len(data)]))
    monkeypatch.setattr(sd, "_BLOCK", 3000)
    parts = sd.runs_of(data, np.array([0, 5000, len(data)]))

    def windows(runs):
        return [(int(s) + j, int(h)) for s, n, h in zip(*runs, strict=True) for j in range(int(n))]

    assert windows(whole) == windows(parts)
    assert [w for w, _ in windows(whole)] == [i for i in range(len(data) - 99) if not 4900 < i < 5000]


def test_cutting_keeps_columns_rows_and_characters(spark):
    rows = passages()
    out = sd.cut_repeats(frame(spark, rows))
    assert out.dtypes == frame(spark, rows).dtypes
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    want = brute(rows)
    for r in rows:
        cut = len((r[1] or "").encode()) - len((got[r[0]]["text"] or "").encode())
        assert want[r[0]][1] - 6 * want[r[0]][2] <= cut <= want[r[0]][1]
        assert got[r[0]]["lang"] == "en" and (got[r[0]]["text"] is None) == (r[1] is None)


def test_null_and_repeated_ids_and_empty(spark):
    long = sentence(random.Random(2), 60)
    rows = [(None, long), (None, long), (3, long), (3, long + " tail")]
    docs = frame(spark, [(i, t, "en", "s", 1, "n", "d", "b", 1, "s") for i, t in rows]).coalesce(1)
    out = [r["text"] for r in sd.cut_repeats(docs).collect()]
    assert sorted(map(len, out)) == sorted([len(long), 0, 0, len(" tail")])
    assert sd.cut_repeats(frame(spark, [])).count() == 0
