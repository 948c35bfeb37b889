"""The batch limiter against the sequential rule, and its plan."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sitelens.operators import windows
from sitelens.streaming import ratelimit as rl

HOUR = 3600 * rl.US
SCHEMA = "id bigint, key string, us bigint, lim bigint"


def traffic(seed):
    """Keys that never pause, that pause, that come in floods of equal times, and odd rows."""
    rng, rows = random.Random(seed), []

    def add(key, lim, times):
        first = len(rows)
        rows.extend((first + k, key, t, lim) for k, t in enumerate(times))

    t = 0
    steady = [t := t + rng.randrange(1, HOUR // 3) for _ in range(400)]
    add("steady", 3, steady)
    add("dense", 5, sorted(rng.randrange(30 * HOUR) for _ in range(700)))
    t = 0
    add("edges", 2, [t := t + rng.choice([HOUR, HOUR - 1, HOUR // 2, 1, 0, 3 * HOUR]) for _ in range(200)])
    add("flood", 4, [rng.choice([0, 5, HOUR, HOUR + 5]) for _ in range(60)])
    add(None, 1, [-5 * HOUR, -5 * HOUR + 7, -4 * HOUR, 0])
    add("one", 1, [rng.randrange(20 * HOUR) for _ in range(120)])
    add("closed", 0, [1, 2])
    add("none", None, [1])
    add("steady", 3, [None])
    rng.shuffle(rows)
    return rows


def sequential(rows, refresh):
    by_key, out = defaultdict(list), {}
    for i, key, t, lim in rows:
        if t is None or not lim:
            out[i] = (False, None, 0)
        else:
            by_key[key].append((t, i, lim))
    for events in by_key.values():
        expiry, count, start = -(2**62), 0, 0
        for t, i, lim in sorted(events):
            if t >= expiry:
                expiry, count, start = t + HOUR, 0, t
            ok = count < lim
            if ok:
                count += 1
                if refresh:
                    expiry = t + HOUR
            out[i] = (ok, start, count)
    return out


@pytest.mark.parametrize("fold", [0, 150, 1 << 17])  # all chained by pointers, some, none
@pytest.mark.parametrize("refresh", [False, True])
def test_batch_equals_the_sequential_rule(spark, monkeypatch, refresh, fold):
    monkeypatch.setattr(windows, "FOLD", fold)
    rows = traffic(fold + 1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = rl.rate_limit(df, F.col("key"), F.timestamp_micros("us"), "id", F.col("lim"), refresh_on_accept=refresh).collect()
    want = sequential(rows, refresh)
    assert len(got) == len(rows)
    assert {r["id"]: (r["accepted"], r["window_start_us"], r["count_in_window"]) for r in got} == want
    assert {r["id"]: r["key"] for r in got} == {i: k for i, k, *_ in rows}


def test_no_python_and_no_window_over_the_events_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(windows, "FOLD", 100)
    df = spark.createDataFrame(traffic(1), SCHEMA)
    out = rl.rate_limit(df, F.col("key"), F.timestamp_micros("us"), "id", F.col("lim"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    e = df.filter("us IS NOT NULL AND lim > 0").select("id", F.col("us").alias("t"), "lim", F.coalesce("key", F.lit("")).alias("k"))
    slices = windows.slices_of(e.withColumn("slice", windows.slice_of(F.col("t"), HOUR)), HOUR)
    # what a window over a whole key sorts is slices, not events
    assert slices.count() < e.count() and slices.agg(F.sum("n")).first()[0] == e.count()
    assert slices.groupBy("k", "slice").count().filter("count > 1").count() == 0


@pytest.mark.parametrize("refresh", [False, True])
def test_no_stage_holds_the_pointers_of_all_rounds(spark, refresh):
    df = spark.createDataFrame(traffic(2), SCHEMA).filter("key = 'steady' AND us IS NOT NULL")
    e = df.select("id", F.col("us").alias("t"), "lim", F.col("key").alias("k")).withColumn("slice", windows.slice_of(F.col("t"), HOUR))
    slices = windows.slices_of(e, HOUR)
    ev = windows.numbered(e, slices).join(slices.select("k", "slice", "burst_last"), ["k", "slice"])
    firsts = slices.filter("before + 1 = burst_first").select("k", F.col("burst_first").alias("s"))
    out = windows.chained(windows.written(ev, "ev"), slices, firsts, 70, HOUR, refresh)
    assert out.count() > 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    # openings are read back, so one join is left, and the events are not broadcast for it
    assert "Generate" not in plan and plan.count("SortMergeJoin") == 1 and "Broadcast" not in plan


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rl.rate_limit(df, F.col("key"), F.timestamp_micros("us"), "id", 3).count() == 0
