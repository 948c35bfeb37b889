"""Streams: restarts, replays, expiry and bounded state."""

import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sitelens.sources.fixtures import Tables
from sitelens.streaming import admission as adm
from sitelens.streaming import ratelimit as rl
from sitelens.streaming import sinks
from tests.conftest import SF_SMALL

START = datetime(2024, 1, 1)
EVENTS = "id bigint, key string, ts timestamp, lim bigint, note string"


def event(i, key, minutes, lim=2):
    return (i, key, START + timedelta(minutes=minutes) if minutes is not None else None, lim, f"n{i}")


def feed(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def limited(spark, folder, **kw):
    src = spark.readStream.schema(EVENTS).parquet(folder)
    return rl.stream_rate_limit(src, F.col("key"), "ts", "id", F.col("lim"), carry=["note"], **kw)


def run(df, out, ck):
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_limiter_resumes_from_its_checkpoint_and_drops_idle_keys(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    parts = [
        [event(1, "a", 0), event(2, "a", 5), event(3, "b", 6), event(4, None, 7), event(5, "a", None), event(6, "z", 1, 0)],
        [event(7, "a", 10), event(8, "b", 20), event(9, "b", 66)],  # a is full; b's window ends at 66
        [event(10, "c", 600), event(11, "a", 601)],
        [event(12, "c", 605)],
    ]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for rows in parts:  # each run is a restart from the checkpoint
        feed(spark, src, rows)
        q = run(limited(spark, src, watermark="10 minutes"), out, ck)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = {r["id"]: r for r in spark.read.parquet(out).collect()}
    every = spark.createDataFrame([r for part in parts for r in part], EVENTS)
    batch = {r["id"]: r for r in rl.rate_limit(every, F.col("key"), F.col("ts"), "id", F.col("lim"), carry=["note"]).collect()}
    assert {i: r.asDict() for i, r in got.items()} == {i: r.asDict() for i, r in batch.items()}
    assert [got[i]["accepted"] for i in range(1, 13)] == [True, True, True, True, False, False, False, True, True, True, True, True]
    # keys whose window the watermark has passed hold no state
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6


def test_state_on_the_clock_has_the_windows_time_to_live(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))

    def rows(first):  # the same times again: only the state's age differs
        return [(first + k, "a", START + timedelta(milliseconds=k), 2, "n") for k in range(3)]

    def wait(n):
        for _ in range(120):
            got = {r["id"]: r["accepted"] for r in spark.read.schema("id bigint, accepted boolean").parquet(out).collect()}
            if len(got) >= n:
                break
            time.sleep(0.5)
        return got

    feed(spark, src, rows(1))
    stream = limited(spark, src, event_time=False, window_seconds=4).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
    q = stream.trigger(processingTime="1 second").start()  # on the clock a query has no last batch
    try:
        time.sleep(1)
        assert wait(3) == {1: True, 2: True, 3: False}
        time.sleep(5)
        feed(spark, src, rows(11))
        assert wait(6) == {1: True, 2: True, 3: False, 11: True, 12: True, 13: False}
    finally:
        q.stop()


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    t = Tables(spark, SF_SMALL)
    out, usage = str(tmp_path / "out"), str(tmp_path / "usage")
    outcomes = adm.admit(t.admissions(), t.admission_dns(), adm.Settings(1, 1, True))
    write = adm.admission_writer(out, usage, t.admission_captures())
    some, rest = outcomes.filter("request_id % 2 = 0"), outcomes.filter("request_id % 2 = 1")
    write(some, 0)
    write(rest, 1)

    def seen():
        used = spark.read.parquet(usage).select("id", "domain", "success", "duration_ms").collect()
        return sorted(map(str, adm.read_outcomes(spark, out).collect())), sorted(map(str, used))

    once = seen()
    write(rest, 1)
    assert seen() == once and len(once[0]) == t.admissions().count()
    kinds = {(r["outcome"], r["status"]) for r in adm.read_outcomes(spark, out).collect()}
    assert kinds >= {("accepted", 200), ("limited", 429), ("rejected", 400), ("rejected", 403)}
    only = adm.read_outcomes(spark, out, "limited")
    assert "PartitionFilters: [isnotnull(outcome" in only._jdf.queryExecution().executedPlan().toString()
    assert len(once[1]) == adm.read_outcomes(spark, out, "accepted").filter("NOT is_ai").count()


def test_settings_are_clamped():
    assert adm.Settings.of({"max_analyses_per_hour": 500}).max_per_hour == 100
    assert adm.Settings.of({"max_analyses_per_hour": 0}).max_per_hour == 1
    assert adm.Settings.of({}) == adm.Settings(10, 5, False)


def test_no_api_key_refuses_what_the_limit_admits(spark):
    t = Tables(spark, SF_SMALL)
    out = adm.admit(t.admissions(), t.admission_dns(), adm.Settings(10, 5, False))
    assert {r["reason"] for r in out.filter("is_ai AND outcome = 'rejected'").select("reason").distinct().collect()} == {"forbidden", "no_api_key"}


def test_daily_counts_keep_open_days_only(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "created_at timestamp"

    def days(*n):
        rows = [(START + timedelta(days=d, hours=1),) for d in n]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = sinks.write_daily_counts(sinks.daily_counts_stream(spark.readStream.schema(schema).parquet(src)), out, ck)
        q.awaitTermination()
        return q

    days(0, 0, 1)
    days(1, 9, 9)
    q = days(10, 0)  # day 0 is over: its late row is dropped
    got = {r["date"]: r["count"] for r in sinks.read_daily_counts(spark, out).collect()}
    assert got == {"2024-01-01": 2, "2024-01-02": 2, "2024-01-10": 2, "2024-01-11": 1}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
    # the last batch once more
    files = spark.read.parquet(out)
    last = files.agg(F.max("batch")).first()[0]
    again = [(r["date"], r["count"]) for r in files.filter(F.col("batch") == last).collect()]
    sinks.batch_writer(out)(spark.createDataFrame(again, "date string, count bigint"), last)
    assert {r["date"]: r["count"] for r in sinks.read_daily_counts(spark, out).collect()} == got


def test_refused_requests_take_one_branch_and_no_part_in_the_watermark(spark, tmp_path):
    t = Tables(spark, SF_SMALL)
    src, out, usage, ck = (str(tmp_path / x) for x in ("in", "out", "usage", "ck"))
    requests = t.admissions()
    # a refused request from the far future leaves the others' windows alone
    far = requests.limit(1).withColumns({"request_id": F.lit(-1).cast("bigint"), "ts": F.lit(datetime(2050, 1, 1)), "raw_url": F.lit(""), "is_ai": F.lit(False)})
    both = requests.unionByName(far)
    both.write.parquet(src)
    stream = adm.admit_stream(spark.readStream.schema(both.schema).parquet(src), t.admission_dns(), adm.Settings(2, 1, True))
    q = adm.run_admission(stream, out, usage, t.admission_captures(), ck)
    q.awaitTermination()
    first = [p for p in q.recentProgress if p["numInputRows"]][0]
    # the stream is scanned by the counted and by the uncounted branch
    assert first["numInputRows"] == 2 * both.count()
    assert first["eventTime"].get("max", "").startswith("2024")
    batch = adm.admit(both, t.admission_dns(), adm.Settings(2, 1, True))
    cols = ["request_id", "outcome", "status", "reason", "is_ai", "client_ip", "url", "count_in_window", "user_id", "ts"]
    assert sorted(map(str, adm.read_outcomes(spark, out).select(cols).collect())) == sorted(map(str, batch.select(cols).collect()))
